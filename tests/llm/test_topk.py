import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import topk


def brute(vectors, queries, k):
    out = set()
    for q_id, q in dict(queries).items():
        s = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in vectors if i != q_id and len(v) == len(q))
        out |= {(q_id, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return out


def run(spark, vectors, queries, k=5):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, vector array<double>")
    return {tuple(r) for r in topk.top_k(frame(vectors), frame(queries), k).collect()}


def test_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(300)] + [(900 + i, [0.0, 0.0, 0.0]) for i in range(9)]
    queries = vectors[::20]
    assert run(spark, vectors, queries) == brute(vectors, queries, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0]), (4, [3.0]), (5, []), (6, [])]
    bad = [(7, None), (8, [None, 1.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (None, [1.0, 1.0])]
    assert run(spark, good + bad, good + bad) == brute(good, good, 5)
    assert run(spark, [], good) == set() and run(spark, good, []) == set()


def test_large_whole_numbers(spark):
    vectors = [(i, [float(2**28 + i * 7), float(i - 3)]) for i in range(12)]
    assert run(spark, vectors, vectors) == brute(vectors, vectors, 5)


def test_scores_beyond_long(spark):
    vectors = [(i, [float(x), 1.0]) for i, x in enumerate([1e30, 2e30, 1e300, -1e30, -3e300, 5.0, 4e18])]
    want = {(q, n, i, s if -2**63 <= s < 2**63 else None) for q, n, i, s in brute(vectors, vectors, 6)}
    assert run(spark, vectors, vectors, 6) == want
    got = spark.createDataFrame([([1e30, -1e17, -0.001],)], "embedding array<double>").select(topk.scaled("embedding").alias("v")).first().v
    assert got == [256e30, -256e17, -1.0]


def test_clashing_names(spark):
    rows = spark.createDataFrame([(i, [float(i)], i) for i in range(9)], "vec_id long, vector array<double>, id long")
    for name in ("v", "dim", "deal", "c_block", "rank", "score", "digits"):
        rows = rows.withColumn(name, F.lit(1))
    assert topk.top_k(rows, rows, 2).count() == 18


def test_blocks_are_dealt_by_number(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "vec_id long, vector array<double>")
    plan = topk.top_k(rows, rows)._jdf.queryExecution().toString()
    assert "SortMergeJoin [dim#" in plan and "deal#" in plan.split("SortMergeJoin")[-1].split("\n")[0]


def test_stops_early():
    rng = np.random.default_rng(1)
    block = np.round(rng.normal(size=(4096, 2)) * 100)
    order, values = topk.sorted_lists(block)
    ids = np.arange(4096)
    for q in block[:20]:
        s, i = topk.threshold_search(block, ids, order, values, q, -1, 5)
        want = sorted(zip(-(block @ q), ids))[:5]
        assert [(-a, b) for a, b in zip(s, i)] == want


def test_scaling(spark):
    got = spark.createDataFrame([([0.1, -0.1, 0.0],)], "embedding array<float>").select(topk.scaled("embedding").alias("v")).first().v
    assert got == [25.0, -26.0, 0.0]


class Counted:
    """A block that counts the rows that are looked up."""

    def __init__(self, block):
        self.block, self.shape, self.dtype, self.rows = block, block.shape, block.dtype, 0

    def __getitem__(self, at):
        self.rows += len(at)
        return self.block[at]


def looked_up(block, queries):
    order, values = topk.sorted_lists(block)
    ids, n = np.arange(len(block)), []
    for q in queries:
        counted = Counted(block)
        s, i = topk.threshold_search(counted, ids, order, values, q, -1, 5)
        assert [(-a, b) for a, b in zip(s, i)] == sorted(zip(-(block @ q), ids))[:5]
        n.append(counted.rows / len(block))
    return n


def test_the_bound_stops_searches_in_few_dimensions():
    """How much of 8192 rows is looked up: little in two to four dimensions, all of it in 64 independent ones (see README)."""
    rng = np.random.default_rng(2)
    share = {d: np.mean(looked_up(block := np.floor(256 * rng.normal(size=(8192, d)) / np.sqrt(d)), block[:20])) for d in (2, 4, 8, 64)}
    assert share[2] < 0.1 and share[4] < 0.25 and share[8] < 0.9 and share[64] == 1


def test_the_bound_stops_searches_of_few_weights():
    """Queries that weigh three of 64 dimensions."""
    rng = np.random.default_rng(3)
    block = np.floor(256 * rng.normal(size=(8192, 64)) / 8)
    queries = np.where(rng.random((20, 64)).argsort(axis=1) < 3, block[:20], 0)
    assert np.mean(looked_up(block, queries)) < 0.2
