import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import neighbours

RNG = np.random.default_rng(5)
CENTRES = RNG.normal(size=(12, 16))
POINTS = np.concatenate([c + 0.25 * RNG.normal(size=(60, 16)) for c in CENTRES])


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = neighbours.unit(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(POINTS)], "id long, e array<double>"), "id", "e")
    centroids = neighbours.train(rows, 12)
    return rows, centroids, neighbours.build(rows, centroids, f"{tmp_path_factory.mktemp('ivf')}/index")


def best(i, k=10):
    x = POINTS / np.linalg.norm(POINTS, axis=1, keepdims=True)
    scores = x @ x[i]
    scores[i] = -9
    return [int(j) for j in np.lexsort((np.arange(len(x)), -scores))[:k]]


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_exact_search(built):
    rows, _, index = built
    assert lists(neighbours.exact(index, rows.where("vec_id % 37 = 0"))) == {i: best(i) for i in range(0, len(POINTS), 37)}


def test_all_probes_find_all_and_few_find_most(built):
    rows, centroids, index = built
    queries = rows.where("vec_id % 9 = 0")
    want = {i: best(i) for i in range(0, len(POINTS), 9)}
    assert lists(neighbours.search(index, centroids, queries, 10, len(centroids))) == want
    probes = neighbours.calibrated(index, centroids, queries)
    got = lists(neighbours.search(index, centroids, queries, 10, probes))
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * 10 * len(want)
    looked = neighbours.scanned(index, centroids, queries, probes).agg(F.avg("n_scanned")).first()[0]
    assert probes <= 4 and looked < 0.4 * len(POINTS)


def test_only_probed_folders_are_read(spark, built):
    rows, centroids, index = built
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    plan = neighbours.search(index, centroids, rows.where("vec_id = 3"), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell#" in plan and plan.count("WindowGroupLimit") >= 1


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0])]
    got = neighbours.unit(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e")
    assert {r.vec_id: [round(x, 9) for x in r.v] for r in got.collect()} == {1: [0.6, 0.8], 7: [1.0, 0.0], 8: [1.0, 0.0]}
    centroids = neighbours.train(got, 1)
    index = neighbours.build(got, centroids, f"{tmp_path}/i")
    assert lists(neighbours.search(index, centroids, got)) == {1: [7, 8], 7: [8, 1], 8: [7, 1]}
    assert neighbours.calibrated(index, centroids, got) == 1
    assert neighbours.train(got.limit(0)).shape == (0, 0)


def test_many_copies_of_one_vector(spark, tmp_path):
    """A third of the rows are copies: they share a cell, ties go to smaller ids."""
    rows = [(i, [1.0, 0.1 * (i % 7)] if i % 3 else [0.0, 1.0]) for i in range(600)]
    vectors = neighbours.unit(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e")
    centroids = neighbours.train(vectors, 5)
    index = neighbours.build(vectors, centroids, f"{tmp_path}/i")
    assert index.count() == 600
    assert lists(neighbours.search(index, centroids, vectors.where("vec_id = 9"), 4, 1)) == {9: [0, 3, 6, 12]}


def test_query_against_all_pairs(spark, sf_dir):
    from lodestream.plans import approximate
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = approximate.nearest_neighbours(spark, sf_dir).collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        scores = np.where(ids == q, -9, x @ x[ids == q][0])
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and 10 <= mine[0].n_scanned <= len(ids)
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[np.argsort(-scores)[:10]].tolist()))
    assert hits >= 0.9 * len(got)


def test_groups_of_bounded_rows(spark, built, monkeypatch):
    """Cells and tables of many rows are searched in groups of their own, with the same rows found; the scores are summed as `dot` does."""
    from lodestream.functions.text import dot
    rows, centroids, index = built
    queries = rows.where("vec_id % 37 = 0")
    whole = lists(neighbours.search(index, centroids, queries, 10, 5))
    met, sizes = neighbours._nearest, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 16)

    def watched(q, r, k):
        sizes.add(1)
        return met(q, r, k)
    monkeypatch.setattr(neighbours, "_nearest", watched)
    assert lists(neighbours.search(index, centroids, queries, 10, 5)) == whole and sizes.value > 2 * len(centroids)
    assert lists(neighbours.exact(index, queries)) == {i: best(i) for i in range(0, len(POINTS), 37)}
    found = neighbours.exact(index, queries).join(queries.selectExpr("vec_id AS query_id", "v AS q"), "query_id").join(rows, "vec_id")
    assert found.where(F.col("score") != dot("q", "v")).count() == 0
