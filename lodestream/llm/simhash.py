"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint takes the majority of each bit over the XXH64 values (seed 42) of
a text's four-word shingles. With 64 bits in seven blocks, two fingerprints that
differ in at most four bits agree in at least three whole blocks, so each of the
35 choices of three blocks is a key, and a pair within the radius shares a key.
Keys of about 27 bits keep chance meetings rare as the corpus grows.

Only distinct fingerprints are linked; copies belong to their fingerprint. A key
that two fingerprints share gives that pair; one of up to BUCKET is searched in
one task, which reports a spanning forest of the links within the radius and not
the pairs. Fingerprints in larger buckets are grouped by the buckets they share;
a group is cut in chunks of BUCKET, and each two chunks of it are searched in a
task of their own, so no group meets in one task and no link is lost. The work
of a group grows with the square of its distinct fingerprints. Connected
components follow from the reported links.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; fewer than four words make one shingle; repeated rows and equal texts
share a class; a null id is never a component's number (a component of null ids
alone has a null one); an empty table gives no rows; other columns are ignored
by `near_duplicates` and kept, whatever their names, by `one_of_each`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import components, rows_of, small_batches, stored, table, words

SHINGLE, SEED, RADIUS = 4, 42, 4
_BLOCKS, _AGREE = 7, 3
#: Most fingerprints that one task compares with each other.
BUCKET = 2048
_CHUNK = 1 << 15


def fingerprint_of(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint."""
    ws = words(text)
    if not ws:
        return 0
    joined = b" ".join(ws)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:max(1, len(ws) - shingle + 1)]
    ends = ends[min(shingle, len(ws)) - 1:]
    n = len(starts)
    digest, totals = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        pairs = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())
        h = np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t or "") for t in texts], np.uint64).view(np.int64))


def fingerprint(text_col: str = "text"):
    """Column: the fingerprint as a signed long."""
    return F.pandas_udf(_fingerprints, "long")(F.coalesce(F.col(text_col), F.lit("")))


def block_masks(blocks: int = _BLOCKS, agree: int = _AGREE) -> list[int]:
    """A mask for every choice of `agree` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the radius.

    right: only pairs across the two are links of the graph.
    """
    if right is None:
        waiting = [left]
    else:
        waiting = [left, right]
    found = []
    side_of = lambda s: 0 if right is None else 1 - s
    while len(waiting[0]):
        queue = [(int(waiting[0][-1]), 0)]
        waiting[0] = waiting[0][:-1]
        while queue:
            x, side = queue.pop()
            other = waiting[side_of(side)]
            near = np.bitwise_count(other ^ np.uint64(x)) <= radius
            if near.any():
                for y in other[near].tolist():
                    found.append((x, y))
                    queue.append((y, side_of(side)))
                waiting[side_of(side)] = other[~near]
    return found


def _links_batch(found):
    a = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["src", "dst"])


def _bucket_links(batches, radius):
    for batch in batches:
        for fps in batch.column("fps").to_pylist():
            yield _links_batch(spanning_links(np.array(fps, np.int64).view(np.uint64), radius=radius))


def _chunk_links(batches, radius):
    for batch in batches:
        for a, b, same in zip(*(batch.column(c).to_pylist() for c in ("fps_a", "fps_b", "same"))):
            left = np.array(a, np.int64).view(np.uint64)
            yield _links_batch(spanning_links(left, None if same else np.array(b, np.int64).view(np.uint64), radius=radius))


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links that connect just the distinct `fp` of fps that pairs within the radius connect."""
    if radius > _BLOCKS - _AGREE:
        raise ValueError("the blocks guarantee a radius of 4 at most")
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks()))
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a row becomes 35
    keys = spread.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sized = stored(keys.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    within = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    found = sized.where("n = 2").where(within("lo", "hi")).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))

    # both sides grow with the corpus: always merged, never broadcast
    shared = keys.join(sized.where("n > 2").select("choice", "key", "n", "lo").hint("merge"), ["choice", "key"])
    shared = stored(shared, "shared-keys")
    lists = shared.where(f"n <= {bucket}").groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = found.union(lists.mapInArrow(lambda b: _bucket_links(b, radius), "src long, dst long"))

    crowded = shared.where(f"n > {bucket}")
    if crowded.isEmpty():
        return found
    star = stored(crowded.where("fp <> lo").select(F.col("fp").alias("src"), F.col("lo").alias("dst")).distinct(), "crowded-star")
    nodes = star.select(F.col("src").alias("node")).union(star.select("dst")).distinct()
    members = stored(components(nodes, star), "crowded")
    total = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / (bucket // 2)).cast("int").alias("chunks"))
    chunked = (members.join(total.hint("merge"), "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
               .groupBy("component", "chunks", "chunk").agg(F.collect_list("node").alias("fps")))
    dealt = (stored(chunked, "crowded-chunks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")))
    meeting = ["component", "low", "high"]
    a = dealt.where("chunk = low").select(*meeting, F.col("fps").alias("fps_a"), (F.col("chunk") == F.col("other")).alias("same"))
    b = dealt.where("chunk = high").select(*meeting, F.col("fps").alias("fps_b"))
    many = a.join(b.hint("merge"), meeting).select("fps_a", "fps_b", "same").mapInArrow(lambda x: _chunk_links(x, radius), "src long, dst long")
    return found.union(many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of each row; component_id the smallest id reachable."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint().alias("fp")), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    grouped = components(classes.select(F.col("fp").alias("node")), links(classes.select("fp"), radius))
    grouped = stored(grouped.withColumnRenamed("node", "fp").join(classes, "fp"), "grouped")
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.select("fp", "component").join(ids, "component").select("fp", "component_id"), "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row of least (id, text hash), all its columns, once."""
    found = near_duplicates(docs, id_col, text_col)
    keys = found.groupBy(F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull()).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    return rows_of(docs, stored(keys.select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash")), "stay"), id_col, text_col)


def op7_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
