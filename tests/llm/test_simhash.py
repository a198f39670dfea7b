import re

import numpy as np
import pytest
import xxhash

from lodestream.llm import simhash


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Component of each fingerprint: its smallest place."""
    a, of = np.array(fps, np.uint64), list(range(len(fps)))
    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= simhash.RADIUS):
            x, y = find(i), find(int(j))
            of[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_tables(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fps = [plain(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, brute(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("bucket", [4, 64])
def test_links_in_crowded_buckets(spark, bucket):
    rng = np.random.default_rng(bucket)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64))) for c in centres for _ in range(40)})
    found = simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), bucket=bucket).collect()
    place, of = {simhash._signed(f): i for i, f in enumerate(fps)}, list(range(len(fps)))
    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    for s, d in found:
        assert bin((s ^ d) & (1 << 64) - 1).count("1") <= simhash.RADIUS
        x, y = find(place[s]), find(place[d])
        of[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == brute(fps)


def test_long_chain(spark):
    fps, x = [], 0
    for b in range(0, 60, 2):
        x |= 3 << b
        fps.append(x)
    from lodestream.llm.common import components
    nodes = spark.createDataFrame([(f,) for f in fps], "node long")
    got = components(nodes, simhash.links(nodes.withColumnRenamed("node", "fp")))
    assert {r.component for r in got.collect()} == {min(fps)}


def test_odd_rows(spark, odd, empty, clashing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8
    blank = [r for r in rows if r.fp == 0]
    assert len(blank) == 3 and {r.component_id for r in blank} == {2}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == [(False, None), (True, 1), (True, 2), (True, 4), (True, 5)]
    assert simhash.one_of_each(empty).collect() == [] and simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(clashing).count() == 5
