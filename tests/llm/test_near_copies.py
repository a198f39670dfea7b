import re

import numpy as np
import pytest

import corpus_pipeline
from lodestream.llm import near_copies
from tests.llm import test_simhash


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(texts):
    """Component of each text by exact Jaccard similarity: its smallest place."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def kept(rows):
    return [i for k, ((i, _), c) in enumerate(zip(rows, brute([t for _, t in rows]))) if c == k]


def edited(n, *at):
    return " ".join(f"changed{i}" if i in at else f"w{i}" for i in range(n))


def test_stage_against_exact_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == kept(rows)


@pytest.mark.parametrize("docs_a_chunk", [2, 1024])
def test_edits(spark, monkeypatch, docs_a_chunk):
    monkeypatch.setattr(near_copies, "CHUNK_DOCS", docs_a_chunk)
    texts = [edited(204), edited(204, 40, 80), edited(204, 40, 80, 120, 160), edited(204, 40, 80, 120, 160, 199), *(edited(204, i) for i in range(20, 200, 9)),
             edited(204, *range(0, 204, 3)), edited(5), edited(4), edited(4), "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == kept(rows)


def test_odd_rows(odd, empty, clashing):
    got = near_copies.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in got.collect()) == [(False, None), (True, 1), (True, 2), (True, 4), (True, 5)]
    assert near_copies.one_of_each(empty).collect() == [] and near_copies.one_of_each(clashing).count() == 5


def test_stage_links_by_simhash_too(spark, sf_dir):
    """Texts of one passage many times over and few words of their own: near fingerprints, unlike sets."""
    passage = " ".join(f"w{i}" for i in range(60)) + " "
    rng = np.random.default_rng(3)
    texts = [passage * 60 + " ".join(f"own{k}x{i}" for i in rng.integers(0, 999, 25)) for k in range(6)]
    texts += [edited(204), edited(204, 40, 80), " ".join(f"else{i}" for i in range(80)), "", None]
    rows = list(enumerate(texts))
    fps = [test_simhash.plain(t) for t in texts]
    near = test_simhash.brute(fps)
    assert brute(texts)[:6] == [0, 1, 2, 3, 4, 5] and near[:6] == [0] * 6  # it takes SimHash to link them
    of = list(range(len(texts)))
    for _ in texts:  # the least of each component of both kinds of links
        for groups in (brute(texts), near):
            of = [min(of[j] for j in range(len(texts)) if groups[j] == groups[i]) for i in range(len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == sorted(set(of)) == [0, 6, 8, 9]
