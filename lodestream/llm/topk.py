"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are packed into blocks of BLOCK rows. A block keeps, for each dimension,
its rows sorted by that component. A query walks all lists in step, from the end
its sign prefers, looks up every row it meets, and stops at the depth where the
threshold (the best total a row not yet met can have) is below its kth score.
Blocks are searched apart and their top k merged, so a task holds a few blocks of
rows and one block of queries whatever the table's size. Blocks are dealt to as
many numbers as there are blocks, and each block of queries goes to all numbers,
so the join has that many keys.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part, nor do rows with a null id; vectors of another dimension than the
query's aren't candidates of it; ties go to the smaller id; each row counts, so
a repeated id can appear more than once (a query leaves out all rows of its own
id); a repeated query id is searched once, with its lexically largest vector; an
empty table gives no rows; other columns are ignored, whatever their names.
Scores are exact whatever the components, and ranked as such; one that a long
can't hold is null in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import stored, table

BLOCK = 8192
QUERY_BLOCK = 512
_EXACT = 2.0**53


def scaled(embedding: str, factor: int = 256):
    """floor(factor * x) of each component, as double."""
    def one(x):
        y = x.cast("double") * F.lit(float(factor))
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)  # doubles beyond are whole
    return F.transform(embedding, one)


def _usable(vector: str):
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def sorted_lists(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per dimension: row numbers by ascending component, and those components."""
    order = np.argsort(block, axis=0, kind="stable").T
    return np.ascontiguousarray(order), np.take_along_axis(block.T, order, axis=1)


def _ranking(scores: np.ndarray, found: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], found[i])), np.int64)
    return np.lexsort((found, -scores))


def threshold_search(block, ids, order, values, query, query_id, k, step=64):
    """The k best (score, id) of a block for a query, by the threshold algorithm."""
    n, d = block.shape
    up = query < 0  # of these lists the smallest components are the best
    seen = np.zeros(n, bool)
    scores, found = np.empty(0, block.dtype), np.empty(0, np.int64)
    depth = 0
    weighing = np.flatnonzero(query != 0)
    while depth < n:
        stop = min(n, depth + step)
        if len(weighing):
            cols = np.where(up[weighing, None], np.arange(depth, stop), n - 1 - np.arange(depth, stop))
            met = seen.copy()
            met[order[weighing[:, None], cols].ravel()] = True
        else:
            met, stop = np.ones(n, bool), n
        new = np.flatnonzero(met & ~seen)
        seen = met
        new = new[ids[new] != query_id]
        scores, found = np.concatenate([scores, block[new] @ query]), np.concatenate([found, ids[new]])
        if len(scores) > k:
            best = _ranking(scores, found)[:k]
            scores, found = scores[best], found[best]
        if seen.all():
            break
        edge = np.where(up, values[:, stop - 1], values[:, n - stop])
        if len(scores) == k and scores.min() > edge @ query:
            break
        depth, step = stop, step * 2
    best = _ranking(scores, found)[:k]
    return scores[best], found[best]


_FOUND = "query_id long, vec_id long, score long, beyond int, digits string"
_DIGITS = 10**700  # more than any score of doubles has


def _rows(queries: list, ids: list, scores: list) -> pa.RecordBatch:
    """Results; a score that a long can't hold is null, and ranked by beyond and digits."""
    beyond = [(x >= 1 << 63) - (x < -(1 << 63)) for x in scores]
    return pa.RecordBatch.from_arrays(
        [pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array([None if o else x for x, o in zip(scores, beyond)], pa.int64()), pa.array(beyond, pa.int32()),
         pa.array([str(_DIGITS + x).zfill(702) if o else None for x, o in zip(scores, beyond)], pa.string())],
        names=["query_id", "vec_id", "score", "beyond", "digits"])


def _search_block(batches, k):
    """For each (candidate block, query block) row: the k best of the block for each query."""
    held: dict = {}
    for batch in batches:
        of = lambda name, i: batch.column(name)[i]
        for i in range(batch.num_rows):
            dim, name = of("dim", i).as_py(), of("c_block", i).as_py()
            array = lambda c, kind, i=i: np.frombuffer(of(c, i).as_buffer(), kind)
            if name not in held:
                if len(held) >= 4:
                    held.pop(next(iter(held)))
                block = array("c_data", np.float64).reshape(of("c_n", i).as_py(), dim).copy()
                held[name] = (block, array("c_ids", np.int64).copy(), *(sorted_lists(block) if dim else (None, None)))
            block, ids, order, values = held[name]
            queries, q_ids = array("q_data", np.float64).reshape(of("q_n", i).as_py(), dim), array("q_ids", np.int64)
            if dim and not float(np.abs(block).max(initial=0)) < _EXACT / max(1.0, float(np.abs(queries).max(initial=0)) * dim):
                as_int = np.frompyfunc(int, 1, 1)  # whole numbers too large for doubles: Python's integers
                block, queries, values = as_int(block), as_int(queries), as_int(values)
            out = ([], [], [])
            for q, q_id in zip(queries, q_ids.tolist()):
                if dim:
                    scores, found = threshold_search(block, ids, order, values, q, q_id, k)
                else:
                    found = np.sort(ids[ids != q_id])[:k]
                    scores = np.zeros(len(found), np.int64)
                for have, more in zip(out, ([q_id] * len(found), found.tolist(), [int(x) for x in scores])):
                    have += more
            yield _rows(*out)


def _packed(df: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows of one block each: (dim, block, n, ids, data); a block is part of a task's rows."""
    def pack(rows):
        waiting: dict[int, list] = {}
        n_out = 0

        def flush(dim, got):
            nonlocal n_out
            n_out += 1
            ids = np.array([i for i, _ in got], np.int64)
            data = np.array([v for _, v in got], np.float64)
            from pyspark import TaskContext
            return pd.DataFrame({"dim": [dim], f"{prefix}_block": [TaskContext.get().partitionId() * (1 << 32) + n_out],
                                 f"{prefix}_n": [len(ids)], f"{prefix}_ids": [ids.tobytes()], f"{prefix}_data": [data.tobytes()]})

        for pdf in rows:
            for i, v in zip(pdf["id"], pdf["v"]):
                got = waiting.setdefault(len(v), [])
                got.append((i, v))
                if len(got) >= size:
                    yield flush(len(v), waiting.pop(len(v)))
        for dim, got in waiting.items():
            yield flush(dim, got)

    return df.mapInPandas(pack, f"dim int, {prefix}_block long, {prefix}_n int, {prefix}_ids binary, {prefix}_data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each row of queries.

    Both have whole-number vectors in vector_col. Query blocks meet candidate
    blocks of their dimension by an equi-join on the number that a block is dealt,
    each pair once.
    """
    def side(df):
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & _usable("v"))

    c = stored(_packed(side(vectors), BLOCK, "c"), "topk-blocks")
    numbers = max(1, c.count())
    c = c.withColumn("deal", F.pmod(F.xxhash64("c_block"), F.lit(numbers)))
    q = _packed(side(queries).groupBy("id").agg(F.max("v").alias("v")), QUERY_BLOCK, "q")
    dealt = q.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))))
    # both sides grow with the corpus: always merged, never broadcast
    both = dealt.join(c.hint("merge"), ["dim", "deal"])
    best = both.mapInArrow(lambda rows: _search_block(rows, k), _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("digits"), F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op8_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding"))
    rows = rows.where(_usable("embedding")).select("vec_id", scaled("embedding").alias("vector"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


_OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op8_top_k": op8_top_k}
ORACLE_SQL = {"op8_top_k": _OP8_SQL}
