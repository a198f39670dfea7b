import numpy as np
import pytest

from lodestream.llm import near_copies, superminhash
from tests.llm.test_near_copies import edited, shingles


def one_by_one(hashes, m):
    """The signature by its definition: every shingle's whole permutation, without stopping."""
    out = [(1 << 64) - 1] * m
    for h in hashes:
        p = list(range(m))
        for rank in range(m):
            x = int(superminhash._random(np.array([h], np.uint64), rank)[0])
            k = rank + (((x & 0xFFFFFFFF) * (m - rank)) >> 32)
            p[rank], p[k] = p[k], p[rank]
            out[p[rank]] = min(out[p[rank]], rank << 32 | x >> 32)
    return out


def test_signatures_stop_early_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(superminhash, "_STEP", 50)
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 7, 0, 30, 300, 1)]
    got = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 16)
    assert got.tolist() == [one_by_one(s, 16) for s in sets]


def pair(rng, union, shared):
    u = rng.integers(0, 1 << 63, union, dtype=np.uint64)
    cut = (union - shared) // 2
    return np.unique(u[:union - cut]), np.unique(u[union - shared - cut:])


@pytest.mark.parametrize("union", [7, 20, 100, 400])
def test_estimate_varies_less_than_independent_minima(union):
    rng = np.random.default_rng(1)
    pairs = [pair(rng, union, round(union * 0.85 + 0.5)) for _ in range(300)]
    sets = [s for p in pairs for s in p]
    found = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    share = (found[::2] == found[1::2]).mean(axis=1)
    true = len(np.intersect1d(*pairs[0])) / union
    assert abs(share.mean() - true) < 0.01
    assert share.var() < 1.1 * true * (1 - true) / superminhash.REGISTERS * (0.5 if union <= 20 else 1)


@pytest.mark.parametrize("union", [7, 20, 60, 200])
def test_pairs_at_the_threshold_meet(union):
    rng = np.random.default_rng(2)
    pairs = [pair(rng, union, -(-85 * union // 100)) for _ in range(1500)]
    keys = superminhash.keys_of([s for p in pairs for s in p])
    assert all(set(a[2:]) & set(b[2:]) for a, b in zip(keys[::2], keys[1::2]))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by exact similarity of all pairs."""
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                of[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def run(docs):
    from pyspark.sql import functions as F
    found = superminhash.near_duplicates(docs)
    return sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id"))).collect()), key=str)


@pytest.mark.parametrize("docs_a_chunk", [3, 1024])
def test_edits(spark, monkeypatch, docs_a_chunk):
    monkeypatch.setattr(near_copies, "CHUNK_DOCS", docs_a_chunk)
    texts = [edited(204), edited(204, 40, 80), edited(204, 40, 80, 120, 160), *(edited(204, i) for i in range(20, 200, 7)), edited(204, *range(0, 204, 9)),
             edited(54, 10), edited(54, 40), edited(54), edited(5), edited(4), edited(4), edited(4).upper(), edited(6), "", None, "  \n"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in superminhash.op13_superminhash(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(odd, empty, clashing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd) == brute(rows)
    assert run(empty) == [] and run(clashing) == run(odd)
