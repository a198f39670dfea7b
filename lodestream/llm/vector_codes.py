"""Vector codes: product quantisation with codebooks from weighted Lloyd rounds over distinct integer parts.

Components become integers, floor(SCALE * x), and vectors are cut into PARTS
consecutive parts. Equal parts of a position are merged into one weighted row
first, so that copies cost nothing more, however many there are; every round
then runs over the distinct rows only. A round assigns each to its nearest entry
and adds up, per task, the weighted sums of each entry's rows: at most ENTRIES
rows a part position leave a task, and the same number in all comes to the
driver, which keeps the codebooks (PARTS * ENTRIES small lists) and sends them
back with the next round. At the end codes and errors of the distinct parts are
joined back to the vectors; that join is merged, so that Spark splits the key of
a vector that has very many copies.

Arithmetic is on whole numbers throughout, so results depend on neither
partitions nor cores.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; nor do those of another length than the most frequent one (the
longer of two that are), as they can't share a codebook, and those with a
component so large that an error might not fit a long (beyond 2**27 as integer at
64 dimensions); a length that PARTS doesn't divide is cut as evenly as whole
numbers allow; null ids come last in the order that entries start from, and rows
of one id go by their integers; fewer vectors than ENTRIES start fewer entries;
each row counts, so a repeated row comes out repeatedly; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import stored, table
from lodestream.llm.topk import _usable, scaled

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Squared distances computed at a time.
_CELLS = 1 << 20


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each whole-number row: its nearest entry, the first of equally near ones, and the squared distance."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, rows.shape[1]) < 1 << 52 else np.int64  # doubles are exact so far
    x, c = rows.astype(kind), entries.astype(kind)
    own, codes, errors = (c * c).sum(axis=1), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, _CELLS // max(1, len(c)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        distance = own - 2 * (part @ c.T)
        best = distance.argmin(axis=1)
        codes.append(best)
        errors.append((distance[np.arange(len(part)), best] + (part * part).sum(axis=1)).astype(np.int64))
    return np.concatenate(codes), np.concatenate(errors)


def _by_position(batch):
    """(position, places in the batch, rows of integers) for each position of a batch of distinct parts."""
    lists, positions = batch.column("part"), batch.column("position").to_numpy()
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()
    for p in np.unique(positions).tolist():
        at = np.flatnonzero(positions == p)
        width = int(ends[at[0] + 1] - ends[at[0]])
        yield p, at, flat[ends[at][:, None] + np.arange(width)].astype(np.int64)


def _sums(batches, books):
    """One row for each entry that a task's rows chose: how many, and the sums of their components."""
    totals = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
    for batch in batches:
        weights = batch.column("weight").to_numpy()
        for p, at, rows in _by_position(batch):
            codes, _ = nearest(rows, books[p])
            np.add.at(totals[p][0], codes, weights[at])
            np.add.at(totals[p][1], codes, rows * weights[at, None])
    for p, (n, sums) in enumerate(totals):
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]),
                                              pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"])


def _codes(batches, books):
    for batch in batches:
        codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
        for p, at, rows in _by_position(batch):
            codes[at], errors[at] = nearest(rows, books[p])
        yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(codes), pa.array(errors)], names=["position", "part", "code", "error"])


def _edges(dim: int) -> list[int]:
    return [p * dim // PARTS for p in range(PARTS + 1)]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(row, vec_id, label, v) of the vectors that take part, and their length."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")).where(_usable("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = lengths.dim if lengths else 0
    limit = min(2**31 - 1, math.isqrt((1 << 62) // max(1, dim)) // 2)
    whole = rows.where(F.size("x") == dim).select("vec_id", "label", scaled("x", SCALE).alias("v"))
    whole = whole.where(F.forall("v", lambda y: F.abs(y) < limit)).withColumn("v", F.col("v").cast("array<int>"))
    return stored(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "vc-vectors"), dim


def parts_of(rows: DataFrame, dim: int) -> DataFrame:
    """(row, vec_id, label, position, part): a row for each part of each vector."""
    cuts = F.array(*(F.slice("v", a + 1, b - a) for a, b in zip(_edges(dim), _edges(dim)[1:])))
    return rows.select("row", "vec_id", "label", F.posexplode(cuts).alias("position", "part"))


def fit(rows: DataFrame, distinct: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    books = [start[:, a:b].copy() for a, b in zip(_edges(dim), _edges(dim)[1:])]
    width = max(b.shape[1] for b in books)
    for _ in range(rounds if len(first) else 0):
        partial = distinct.mapInArrow(lambda batches, books=books: _sums(batches, books), "position int, entry int, n long, sums array<bigint>")
        total = partial.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
        books = [b.copy() for b in books]
        for r in total.collect():
            books[r.position][r.entry] = [s // r.n for s in r.sums[:books[r.position].shape[1]]]
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) of each vector that takes part, codes an array of entry numbers; and the codebooks."""
    rows, dim = integer_vectors(vectors, id_col, vector_col, label_col)
    distinct = stored(parts_of(rows, dim).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "vc-distinct")
    books = fit(rows, distinct, dim, entries, rounds)
    coded = distinct.mapInArrow(lambda batches: _codes(batches, books), "position int, part array<int>, code int, error long")
    # both sides grow with the corpus: always merged, never broadcast; the part of a hot vector is split by AQE
    met = parts_of(rows, dim).join(coded.hint("merge"), ["position", "part"])
    by_place = F.array(*(F.max(F.when(F.col("position") == p, F.col("code"))) for p in range(PARTS)))
    return met.groupBy("row", "vec_id", "label").agg(by_place.alias("codes"), F.sum("error").alias("error")).drop("row"), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all integer components by part, entry and position within the part, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir):
    found, books = encode(table(spark, sf_dir, "embeddings"))
    found = stored(found, "vc-codes")
    sums = stored(found.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "vc-labels")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    # sums is written first: Spark broadcasts it only if its measured size is under the session's limit
    return found.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps, distance = [], "list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, position, part, arg_min(entry, (d, entry)) AS entry, min(d) AS error
  FROM (SELECT p.row, p.position, p.part, c.entry, {distance} AS d FROM p JOIN c{r} c ON p.position = c.position) GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT position, entry, i, floor(sum(part[i])::DOUBLE / count(*))::BIGINT AS x
  FROM (SELECT position, entry, part, unnest(range(1, len(part) + 1)) AS i FROM a{r}) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.position, c.entry, coalesce(n.part, c.part) AS part
  FROM c{r} c LEFT JOIN (SELECT position, entry, list(x ORDER BY i) AS part FROM s{r} GROUP BY ALL) n ON c.position = n.position AND c.entry = n.entry)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, x) AS row, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)),
p AS MATERIALIZED (
  SELECT row, g.position, x[g.position * len(x) // {PARTS} + 1:(g.position + 1) * len(x) // {PARTS}] AS part
  FROM v, generate_series(0, {PARTS - 1}) AS g(position)),
c0 AS MATERIALIZED (SELECT position, row - 1 AS entry, part FROM p WHERE row <= {ENTRIES}),{",".join(steps)},
f AS (SELECT v.vec_id, v.label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY position) AS code, sum(error)::BIGINT AS error
  FROM v JOIN a{ROUNDS} USING (row) GROUP BY row, v.vec_id, v.label),
b AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, b
"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL = {"op11_vector_codes": _oracle()}
