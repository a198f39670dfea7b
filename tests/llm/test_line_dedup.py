import random
from collections import Counter

import hypothesis.strategies as st
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings

from lodestream.llm import line_dedup


def brute(docs, min_words, run_words):
    """docs in order: the words of each that stay, by the rule as it stands."""
    gone, seen = [set() for _ in docs], set()
    for d, t in enumerate(docs):
        lines, at = [], 0
        for x in (t or "").split("\n"):
            n = len(x.split(" ")) if x.strip() else 0
            if n:
                lines.append((at, at + n, x))
            at += n
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, _, x in lines[a:b + 1])
                if lines[b][1] - lines[a][0] >= min_words:
                    if run in seen:
                        gone[d] |= set(range(lines[a][0], lines[b][1]))
                    seen.add(run)
    first = {}
    for d, t in enumerate(docs):
        ws = (t or "").split()
        for i in range(len(ws) - run_words + 1):
            e, j = first.setdefault(tuple(ws[i:i + run_words]), (d, i))
            if e != d or i - j >= run_words:
                gone[d] |= set(range(i, i + run_words))
    return [[w for i, w in enumerate((t or "").split()) if i not in g] for t, g in zip(docs, gone)]


def run(spark, docs, min_words, run_words):
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(rows, min_words=min_words, run_words=run_words).collect()}
    for i, t in enumerate(docs):
        assert len((t or "").split()) == len((got[i].text or "").split()) + got[i].n_removed
    return [(got[i].text or "").split() for i in range(len(docs))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_least_of_each_window(values, width):
    got = line_dedup.least_of(np.array(values, np.int64), width)
    windows = [values[i:i + width] for i in range(len(values) - width + 1)]
    assert width > max(1, len(values)) or got.tolist() == [i + max(k for k, v in enumerate(w) if v == min(w)) for i, w in enumerate(windows)]


def many(seed):
    """Few words, so that runs repeat in all ways, themselves included; lines of all lengths."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abc", k=rng.randrange(1, 25))) for _ in range(6)] + [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(4)]
    piece = lambda: rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 12)))
    return ["".join(piece() + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(line_dedup, "GRAM", 3)
    docs = [*many(seed), None, "", "z " * 40]
    docs = ["\n".join(x.strip() for x in t.split("\n")) if t else t for t in docs]
    assert run(spark, docs, 5, 9) == brute(docs, 5, 9)


def test_passage_inside_a_line(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(57)
    docs = [" ".join(prose(a) + passage + prose(b)) for a, b in ((30, 40), (0, 70), (81, 0), (500, 3))] + [" ".join(prose(300))]
    got = run(spark, docs, 12, 50)
    assert got == brute(docs, 12, 50)
    assert [len(x) for x in got] == [127, 70, 81, 503, 300]


def test_fingerprints_decide(spark, monkeypatch):
    """Places meet through their fingerprints: where these differ, nothing is found."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [f"a{i} {text}" if i % 2 else f"{text}\nb{i}" for i in range(6)]
    assert run(spark, docs, 5, 9) == brute(docs, 5, 9) != [t.split() for t in docs]
    whole = line_dedup.marks_of

    rows = spark.createDataFrame(list(enumerate(docs)), "ld_id long, ld_text string").selectExpr("*", "xxhash64(ld_text) ld_hash")
    emit = line_dedup._emit
    assert line_dedup.repeated_runs(rows, 5, 9).count() > 0
    marks = lambda: [m for t in docs for m in whole([t.encode()], 5, 9)[1].tolist()]
    assert max(Counter(marks()).values()) > 1
    lone = lambda batches, *a: (b.set_column(2, "ld_fp", pa.array(np.arange(b.num_rows) + 10**6 * np.array(b.column("ld_id").to_pylist(), np.int64))) for b in emit(batches, *a))
    monkeypatch.setattr(line_dedup, "_emit", lone)
    assert line_dedup.repeated_runs(rows, 5, 9).count() == 0


def test_text_keeps_its_lines():
    cut = lambda *runs: line_dedup.keep_words("a b\nc d\n\n e f", [x for x, _ in runs], [y for _, y in runs])
    assert cut((0, 0)) == ("a b\nc d\n\n e f", 0)
    assert cut((2, 4)) == ("a b\ne f", 2)
    assert cut((1, 3), (2, 4)) == ("a \ne f", 3)
    assert cut((0, 2)) == ("c d\n\n e f", 2)
    assert cut((5, 6)) == ("a b\nc d\n\n e ", 1)


def test_hot_line(spark):
    line = "this line stands in very many of the documents of this small table here"
    docs = spark.createDataFrame([(i, f"only {i}\n{line}\nother {i}") for i in range(500)], "doc_id long, text string")
    got = Counter(r.n_removed for r in line_dedup.dedup_lines(docs).collect())
    assert got == {len(line.split()): 499, 0: 1}


def test_odd_rows(odd, empty, clashing):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_removed"]
    want = Counter((r.doc_id, "word " * 50 if r.doc_id == 5 else r.text) for r in odd.collect())  # the later words repeat the first 50
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty).collect() == []
    assert line_dedup.dedup_lines(clashing).count() == clashing.count()
    taken = odd.withColumnsRenamed({"lang": "ld_id", "source": "ld_row", "n_chars": "n_removed"})
    got = line_dedup.dedup_lines(taken)
    assert got.columns == ["doc_id", "text", "ld_id", "ld_row", "n_removed"]
    assert Counter((r.doc_id, r.ld_id, r.ld_row, r.n_removed) for r in got.collect()) == Counter((r.doc_id, r.lang, r.source, 29950 * (r.doc_id == 5)) for r in odd.collect())
