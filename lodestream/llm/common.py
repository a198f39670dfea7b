"""What the operators of this package share: reading, materialising, hashing, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.sources.shared import app_dir, shared_dir  # noqa: F401
from lodestream.sources.tables import table  # noqa: F401  the operators take it from here

#: Rows in an Arrow batch: 1024 documents bound a worker's memory at a few MB for usual texts.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Python workers see at most BATCH_ROWS rows at a time. The setting stays, as plans that were made under it run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Folders that own_path puts new paths in, the innermost last.
_SCOPES: list[str] = []


def own_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder."""
    return "/".join([app_dir(spark), *_SCOPES[-1:], f"{tag}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is stored inside is deleted at the end, when what was made of it has to be written elsewhere."""
    _SCOPES.append(f"scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{app_dir(spark)}/{_SCOPES.pop()}")


def clean(spark: SparkSession) -> None:
    """Delete what this application has stored; results that have not been written elsewhere go with it."""
    _delete(spark, app_dir(spark))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there when an executor is lost."""
    path = own_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs with one of the keys (id, xxhash64 of the text), all their columns; of rows with equal keys one."""
    mine = docs.select(docs[f"`{id_col}`"].alias("of_id"), F.xxhash64(docs[f"`{text_col}`"]).alias("of_hash"),
                       F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))  # the caller's names stay out of the way
    same = (F.col("of_hash") == F.col("hash")) & F.col("of_id").eqNullSafe(F.col("id"))
    often = mine.groupBy("of_id", "of_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = mine.join(keys.select("id", "hash"), same, "left_semi")
    if not keys.join(often, same, "left_semi").isEmpty():
        kept = kept.dropDuplicates(["of_id", "of_hash"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words, as UTF-8: runs of bytes other than space and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable.

    nodes: one column `node`, distinct longs. edges: `src`, `dst`, any order,
    repeats and loops allowed. Alternates large-star and small-star steps, whose
    results stay as long as the edges were and which converge after about the
    logarithm of the longest path. Every step is a min aggregation plus an
    equi-join, and is checkpointed in the shared folder.
    """
    e = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stored(e, "edges")
    state = None
    while True:
        e = stored(_small_star(_large_star(e)), "star")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    return nodes.join(e, nodes.node == e.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())
