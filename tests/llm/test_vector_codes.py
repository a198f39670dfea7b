import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Row by row over all vectors, without merging equal parts: (vec_id, codes, error), and the codebooks."""
    kept = sorted(((i is None, i or 0), [math.floor(1024 * x) for x in np.array(v, np.float32).tolist()]) for i, v, _ in rows
                  if v is not None and all(x is not None and math.isfinite(x) for x in v))
    d = len(kept[0][1])
    cut = lambda v: [tuple(v[p * d // 4:(p + 1) * d // 4]) for p in range(4)]
    parts = [cut(v) for _, v in kept]
    books = [[q[p] for q in parts[:entries]] for p in range(4)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            mine = [[] for _ in books[p]]
            for q in parts:
                mine[assign(p, q[p])[1]].append(q[p])
            new.append([tuple(sum(x) // len(m) for x in zip(*m)) if m else c for m, c in zip(mine, books[p])])
        books = new
    found = []
    for ((no_id, i), _), q in zip(kept, parts):
        best = [assign(p, x) for p, x in enumerate(q)]
        found.append((None if no_id else i, tuple(k for _, k in best), sum(e for e, _ in best)))
    return sorted(found, key=str), books


def run(spark, rows, **more):
    found, books = vector_codes.encode(spark.createDataFrame(rows, SCHEMA), **more)
    got = sorted(((r.vec_id, tuple(r.codes), r.error) for r in found.collect()), key=str)
    return got, [[tuple(map(int, e)) for e in b] for b in books]


@pytest.mark.parametrize("dim", [8, 6])
def test_against_rows_one_by_one(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i * 3, [float(x) for x in np.round(rng.normal(size=dim), 2).astype(np.float32)], i % 3) for i in range(80)]
    rows += [(1000 + i, rows[5][1], None) for i in range(40)] + [rows[7], (None, rows[9][1], 1)]
    assert run(spark, rows, entries=16) == brute(rows, 16)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(4, [0.5, -0.5, 1.0, 0.0], 1), (2, [0.5, -0.25, 1.0, -0.0], None), (2, [0.5, -0.25, 1.0, -0.0], None), (7, [0.0] * 4, 1)]
    bad = [(1, None, 1), (0, [None, 1.0, 1.0, 1.0], 1), (3, [nan] * 4, 1), (5, [inf, 0.0, 0.0, 0.0], 2)]
    odd = [(8, [1.0, 2.0], 1), (9, [], 1), (10, [1e30, 0.0, 0.0, 0.0], 1)]  # another length; too large
    assert run(spark, good + bad + odd) == brute(good)
    assert run(spark, [])[0] == [] and run(spark, bad)[0] == []


def test_large_integers_are_exact(spark):
    rows = [(i, [float(2**14 + i), float(-(2**15) + 3 * i), float(i), 0.0], 0) for i in range(20)]
    assert run(spark, rows, entries=3) == brute(rows, 3)


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(200)], SCHEMA)
    for name in ("row", "v", "x", "position", "part", "weight", "code", "error"):
        rows = rows.withColumn(name, F.lit(1))
    a, b = (vector_codes.encode(rows.repartition(n), entries=20) for n in (1, 7))
    assert sorted(map(tuple, a[0].collect())) == sorted(map(tuple, b[0].collect())) and vector_codes.digest(a[1]) == vector_codes.digest(b[1])


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = brute(rows)
    sums = {}
    label = {i: k for i, _, k in rows}
    for i, _, e in want:
        sums[label[i]] = sums.get(label[i], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = [(i, "".join(f"{c:02x}" for c in codes), e, sums[label[i]], sha) for i, codes, e in want]
    assert sorted(map(tuple, vector_codes.op11_vector_codes(spark, sf_dir).collect())) == sorted(want)


def test_parts_meet_by_merging(spark, sf_dir):
    found, _ = vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin [position#" in plan and "Broadcast" not in plan.split("Physical Plan")[-1]
