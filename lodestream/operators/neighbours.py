"""Approximate nearest neighbours by cosine, with an inverted file: a table of vectors partitioned by cell.

Cells are the k-means clusters of a sample; the sample's size and the number of
cells are bounded parameters, so centroids are small whatever the table's size.
The index holds every vector under its nearest centroid. A query is sent to the
cells of its nearest centroids (`probes`) and meets their vectors there, as matrices
of GROUP_ROWS rows or so, so that only the probed folders are read and cells of very
many rows are many tasks' work. `calibrated` picks the probes for a wished
recall, from the cells that the true neighbours of a bounded number of queries
are in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.text import dot
from lodestream.operators.sampling import bernoulli

#: Vectors that k-means sees, about; cells at most; queries that calibration looks at, about.
TRAIN_ROWS, MOST_CELLS, CALIBRATION_QUERIES = 50_000, 4096, 256
#: Calibration aims this much above the wished recall.
MARGIN = 0.03
#: Rows, about, that meet queries in one call, and queries whose scores are held at once.
GROUP_ROWS, _QUERIES = 4096, 32


def unit(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of length one. Those that are null, zero or hold a null or non-finite component are left out, and null ids."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fit = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fit)
    norm = F.sqrt(dot("v", "v"))
    return rows.withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')").select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _share(df: DataFrame, rows: int) -> float:
    return rows / max(rows, df.count())


def train(vectors: DataFrame, cells: int | None = None, seed: int = 11) -> np.ndarray:
    """Centroids of unit vectors; cells: by default the root of their number, MOST_CELLS at most."""
    n = vectors.count()
    cells = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
    sample = bernoulli(vectors, TRAIN_ROWS / max(TRAIN_ROWS, n), ["vec_id"], seed)
    # a small file is one task otherwise, in every round
    sample = sample.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "vec_id").select(array_to_vector("v").alias("features"))
    if sample.isEmpty():
        return np.zeros((0, 0))
    return np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(sample).clusterCenters()) if cells > 1 else np.array([sample.first().features.toArray()])


def _ranked(centroids: np.ndarray, vectors: pd.Series, most: int) -> np.ndarray:
    """The nearest cells of each vector, the nearest first."""
    x = np.stack(vectors.to_numpy())
    far = (centroids * centroids).sum(axis=1) / 2 - x @ centroids.T
    return far.argmin(axis=1)[:, None] if most == 1 else np.argsort(far, axis=1, kind="stable")[:, :most]


def _with_cells(vectors: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """(vec_id, v, cell, place): a row for each of the nearest cells, place from 1."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                cells = _ranked(centroids, rows["v"], most)
                n = cells.shape[1]
                yield pd.DataFrame({"vec_id": rows["vec_id"].repeat(n), "v": rows["v"].repeat(n), "cell": cells.ravel(), "place": np.tile(np.arange(1, n + 1), len(rows))})
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInPandas(of, f"vec_id {kind}, v array<double>, cell int, place int")


def build(vectors: DataFrame, centroids: np.ndarray, path: str) -> DataFrame:
    """Write the index of unit vectors, a folder for each cell, and read it."""
    spark = vectors.sparkSession
    # rebalanced by cell: small cells share a task, and Spark splits large ones
    _with_cells(vectors, centroids, 1).drop("place").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return load(spark, path, vectors.schema["vec_id"].dataType.simpleString())


def load(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"vec_id {id_type}, v array<double>, cell int").parquet(path)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): Spark keeps each task's k best before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dots(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of components, so that equal vectors have equal ones."""
    out = np.zeros((len(q), columns.shape[1]))
    for j, column in enumerate(columns):
        out += q[:, j, None] * column
    return out


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score, cell) of the k best of these rows for each of these queries, their own id left out."""
    found = []
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, cells = rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
        columns, q, of = np.ascontiguousarray(np.stack(rows["v"].to_numpy()).T), np.stack(queries["q"].to_numpy()), queries["query_id"].to_numpy()
        for a in range(0, len(q), _QUERIES):
            scores = _dots(q[a:a + _QUERIES], columns)
            scores[of[a:a + _QUERIES, None] == ids] = -np.inf
            least = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            for i, s in enumerate(scores):
                above = np.flatnonzero(s > least[i])
                pick = np.append(above, np.flatnonzero(s == least[i])[:max(0, k - len(above))])  # ties to smaller ids
                pick = pick[s[pick] > -np.inf]
                found.append(pd.DataFrame({"query_id": of[a + i], "vec_id": ids[pick], "score": s[pick], "cell": cells[pick]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "cell": []})


def _met(queries: DataFrame, rows: DataFrame, on: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, score, cell): the k best rows of each group for each query that is sent there."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    return queries.groupBy(*on).cogroup(rows.groupBy(*on)).applyInPandas(
        lambda q, r: _nearest(q, r, k), f"query_id {kind}, vec_id {kind}, score double, cell int")


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows found for each of the unit vectors `queries`, their own id left out."""
    probed = _with_cells(queries, centroids, probes).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell")
    # a row for each cell
    parts = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    rows = index.join(F.broadcast(probed.select("cell").distinct().join(F.broadcast(parts), "cell")), "cell")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    sent = probed.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return _best(_met(sent, rows, ["cell", "part"], k), k).select("query_id", "rank", "vec_id", "score")


def scanned(index: DataFrame, centroids: np.ndarray, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, n_scanned): the rows that a search looks at for each query."""
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return _with_cells(queries, centroids, probes).join(sizes, "cell").groupBy(F.col("vec_id").alias("query_id")).agg(F.sum("n").alias("n_scanned"))


def exact(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score, cell) by looking at all rows: these are dealt by number, and each query goes to every number."""
    deals = max(1, -(-index.count() // GROUP_ROWS))
    everywhere = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    rows = index.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(deals)).cast("int"))
    return _best(_met(everywhere, rows, ["deal"], k), k).select("query_id", "rank", "vec_id", "score", "cell")


def calibrated(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, recall: float = 0.9) -> int:
    """The fewest probes with which a sample of the queries would find this share of their true neighbours, and MARGIN more."""
    some = bernoulli(queries, _share(queries, CALIBRATION_QUERIES), ["vec_id"])
    true = exact(index, some, k).select("query_id", "cell")
    places = _with_cells(some, centroids, len(centroids)).select(F.col("vec_id").alias("query_id"), "cell", "place")
    found = dict(true.join(places, ["query_id", "cell"]).groupBy("place").count().collect())  # a number for each cell at most
    total, wanted = 0, min(1.0, recall + MARGIN) * sum(found.values())
    for place in sorted(found):
        total += found[place]
        if total >= wanted:
            return place
    return max(1, len(centroids))
