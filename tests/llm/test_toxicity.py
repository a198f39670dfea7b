import itertools
import re

import numpy as np
import pytest

from lodestream.llm import toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 7, 3])
    e, pairs, start = rng.normal(size=16), rng.normal(size=(2, 2)), 0.3
    got, at = toxicity.marginals(e, lengths, pairs, start), 0
    for n in lengths:
        x = e[at:at + n]
        weight = {}
        for tags in itertools.product((0, 1), repeat=int(n)):
            s = sum(a * b for a, b in zip(tags, x)) + (start * tags[0] if n else 0)
            weight[tags] = np.exp(s + sum(pairs[a, b] for a, b in zip(tags, tags[1:])))
        total = sum(weight.values())
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for t, w in weight.items() if t[i]) / total)
        at += n


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.8


def test_odd_rows(spark, odd, empty, clashing):
    texts = ["you scum and trash", "a nice day today", "the scum is here", "what a lovely tree"] * 20
    model = toxicity.fit([f"{t} {i}" for i, t in enumerate(texts)], np.array([1, 0, 1, 0] * 20), np.ones(80))
    got = toxicity.with_toxicity(odd, model).collect()
    assert len(got) == 8 and all(0 <= r.toxicity.score <= 1 for r in got)
    assert got[1].toxicity.score == got[3].toxicity.score == got[7].toxicity.score
    assert toxicity.with_toxicity(empty, model).collect() == []
    assert toxicity.with_toxicity(clashing, model).columns == [*clashing.columns, "toxicity"]
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    one = toxicity.fit_on(odd, labels)
    assert all(r.toxicity.score > 0.99 for r in toxicity.with_toxicity(odd, one).collect())
    none = toxicity.fit_on(odd, labels.where("doc_id = 77"))
    assert all(r.toxicity.score < 0.01 for r in toxicity.with_toxicity(odd, none).collect())


def test_spans_are_code_points():
    rng = np.random.default_rng(0)
    prose = [" ".join(f"w{k}" for k in rng.integers(0, 500, 30)) for _ in range(80)]
    texts = [f"{t} scum" if i % 2 else t for i, t in enumerate(prose)]
    model = toxicity.fit(texts, np.arange(80) % 2, np.ones(80))
    text = "É, \"SCUM\" ici"
    _, found = toxicity._score_texts([text], model, toxicity._Emissions(model), True)
    assert [text[s["start"]:s["end"]] for s in found[0]] == ["SCUM"]


def test_scores_against_enumeration():
    """Score and spans of short texts, from the model's numbers and all ways to tag their tokens."""
    rng = np.random.default_rng(4)
    prose = [" ".join(f"w{k}" for k in rng.integers(0, 60, 12)) + (" vile scum" if i % 2 else "") for i in range(120)]
    model = toxicity.fit(prose, np.arange(120) % 2, np.ones(120))
    for text in ["w1 scum w2 vile", "scum", "", "w5 w6 w7 w8 w9", "vile vile SCUM w1", "w3, x-y zz"]:
        words = re.findall(r"[0-9a-z]+", text.lower())
        e = [sum(float(model.weights[f]) for f in toxicity._features(w.encode(), model.ratios)) for w in words]
        weigh = {}
        for tags in itertools.product((0, 1), repeat=len(words)):
            s = sum(x for t, x in zip(tags, e) if t) + (model.start * tags[0] if tags else 0) + sum(model.pairs[a, b] for a, b in zip(tags, tags[1:]))
            weigh[tags] = np.exp(s)
        p = [sum(v for t, v in weigh.items() if t[i]) / sum(weigh.values()) for i in range(len(words))]
        x = np.array([1, max(p, default=0), np.log1p(sum(p)), sum(p) / len(p) if p else 0])
        score, spans = toxicity._score_texts([text], model, toxicity._Emissions(model), True)
        assert score[0] == pytest.approx(1 / (1 + np.exp(-x @ model.logistic)), rel=1e-6)
        assert [text[s["start"]:s["end"]].lower() for s in spans[0]] == [w for w, q in zip(words, p) if q >= 0.5]


def test_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400)
    rows = [(i, ("scum " if i % 2 else "fine ") * 20, i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, weights: seen.append((len(texts), labels.tolist())))
    toxicity.fit_on(docs.drop("toxic"), docs.drop("text"))
    assert seen == [(8, [*seen[0][1]])] and sum(seen[0][1]) == 4


def test_a_long_text_does_not_empty_its_label(spark, monkeypatch):
    """Whichever comes first by hash: a text longer than the bound is cut for the fit, and others of its label follow."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 4000)
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 500)
    rng = np.random.default_rng(4)
    prose = [" ".join(f"w{k}" for k in rng.integers(0, 60, 12)) + (" vile scum" if i % 2 else "") for i in range(160)]
    for long in (1, 3, 5, 7):
        rows = [(i, t * 200 if i == long else t, i % 2) for i, t in enumerate(prose)]
        docs = spark.createDataFrame([*rows, rows[long], (long, "another text of this id", 1)], "doc_id long, text string, toxic int")
        model = toxicity.fit_on(docs.drop("toxic"), docs.drop("text"))
        got = toxicity.with_toxicity(docs.where("text not like 'another%'"), model).collect()
        assert sum((r.toxicity.score > 0.5) == bool(r.doc_id % 2) for r in got) > 150
