"""Near copies by the similarity of their sets of word shingles.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is SIMILARITY or more. Documents of equal sets form a class. MinHash
bands only deal out candidates: classes that share a band are joined in groups,
and within a group every link is decided by the sets themselves. A pair at just
0.8 shares none of the 24 bands of four with a chance of about 3 in a million.

A group beyond CHUNK_DOCS classes or CHUNK_SHINGLES shingles is cut in chunks,
and each two chunks are searched in a task of their own, so no group meets in
one task and no link is lost; the work grows with the square of such a group.
A search reports a spanning forest of the links and not the pairs.

With by_simhash, documents whose SimHash fingerprints (`simhash.py`: 64 bits over
four-word shingles, repeats included) differ in four bits or fewer are linked too,
so that components are those of both kinds of links.

Defined cases: null and wordless texts are one class; fewer than five words make
one shingle; repeated rows and equal texts share a class; of each component the
row of least (id, text hash) stays, null ids last; an empty table gives no rows;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import simhash
from lodestream.llm.common import components, rows_of, small_batches, stored, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 4
CHUNK_DOCS, CHUNK_SHINGLES = 1024, 250_000
#: Groups in an Arrow batch.
BATCH_GROUPS = 32
_STEP = 4096
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = (_RNG.integers(0, 1 << 31, (BANDS * BAND_ROWS, 1), dtype=np.uint32) << np.uint32(1)) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32)
_ROW_TIMES = _RNG.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_PLUS = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    ws = words(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    k = min(SHINGLE, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i:i + n] * _FACTORS[i]
    return np.unique(_mixed(total))


def keys_of(found: np.ndarray) -> np.ndarray:
    """Hash of the set, its size and its bands; of an empty set only (0, 0)."""
    if not len(found):
        return np.zeros(2, np.int64)
    low, least = found.astype(np.uint32), np.full(len(_TIMES), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _STEP):
        np.minimum(least, (low[at:at + _STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    bands = _mixed((least.reshape(BANDS, BAND_ROWS) * _ROW_TIMES).sum(axis=1, dtype=np.uint64) + _BAND_PLUS)
    head = np.array([xxhash.xxh64_intdigest(found.tobytes()), len(found)], np.uint64)
    return np.concatenate([head, bands]).view(np.int64)


def _keys(texts: pd.Series) -> pd.Series:
    return pd.Series([keys_of(shingles(t or "")) for t in texts], dtype=object)


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t or "").tobytes() for t in texts], dtype=object)


def links_within(nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, other: int = 0, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs at the similarity or above; hashes: of all sets, one after the other.

    other: over 0 if only pairs of one of the first so many and one of the rest are links of the graph.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, flat = np.unique(hashes, return_inverse=True)
    flat = flat.astype(np.int32)
    marked = np.zeros(int(flat.max()) + 1, bool)
    side = np.arange(len(nodes)) >= other if other else None
    waiting, found = np.ones(len(nodes), bool), []
    for root in range(len(nodes)):
        queue = [root] if waiting[root] else []
        waiting[root] = False
        while queue:
            x = queue.pop()
            fit = waiting & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-9)
            if side is not None:
                fit &= side != side[x]
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            mine = flat[starts[x]:ends[x]]
            marked[mine] = True
            if 2 * sizes[at].sum() > len(flat):
                shared = np.add.reduceat(marked[flat], starts, dtype=np.int64)[at]
            else:
                shared = np.array([np.count_nonzero(marked[flat[starts[y]:ends[y]]]) for y in at])
            marked[mine] = False
            near = at[shared >= similarity * (sizes[at] + sizes[x] - shared) - 1e-9].tolist()
            waiting[near] = False
            found += [(int(nodes[x]), int(nodes[y])) for y in near]
            queue += near
    return found


def _held(lists) -> list:
    """(nodes, sizes, hashes) of each list, read from Arrow's buffers; None for a null."""
    found = []
    for i in range(len(lists)):
        one = lists[i].values
        if one is None:
            found.append(None)
            continue
        data = one.field("shingles")
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1]
        hashes = np.frombuffer(data.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.uint64)
        found.append((one.field("node").to_numpy(), np.diff(ends).astype(np.int64) // 8, hashes))
    return found


def _search(batches, similarity):
    for batch in batches:
        for a, b in zip(_held(batch.column("members")), _held(batch.column("others"))):
            both = a if b is None else [np.concatenate(x) for x in zip(a, b)]
            found = links_within(*both, 0 if b is None else len(a[0]), similarity)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, size, id, hash, component, chunk, chunks): the classes that share bands with others."""
    keys = classes.select("node", F.explode(F.slice("keys", 3, F.size("keys"))).alias("key"))  # all bands
    sized = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo")).where("n > 1"), "near-bands")
    # both sides grow with the corpus: always merged, never broadcast
    star = stored(keys.join(sized.select("key", "lo").hint("merge"), "key").where("node <> lo").select(F.col("node").alias("src"), F.col("lo").alias("dst")).distinct(), "near-star")
    nodes = star.select(F.col("src").alias("node")).union(star.select("dst")).distinct()
    members = stored(components(nodes, star).join(classes.drop("keys").hint("merge"), "node"), "near-groups")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int")
    totals = members.groupBy("component").agg(chunks.alias("chunks"))
    return members.join(totals.hint("merge"), "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): links that connect just the classes that pairs at the similarity or above connect."""
    wanted = _candidates(classes)
    texts = docs.select(F.col(id_col).alias("nd_id"), F.xxhash64(text_col).alias("nd_hash"), F.col(text_col).alias("nd_text"))
    held = texts.join(wanted.hint("merge"), (F.col("nd_hash") == F.col("hash")) & F.col("nd_id").eqNullSafe(F.col("id")))
    held = held.select("component", "chunk", "chunks", "node", F.pandas_udf(_sets, "binary")(F.coalesce("nd_text", F.lit(""))).alias("shingles"))
    held = held.dropDuplicates(["node"])  # repeated rows
    lists = stored(held.groupBy("component", "chunk").agg(F.first("chunks").alias("chunks"), F.collect_list(F.struct("node", "shingles")).alias("members")), "near-chunks")
    own = lists.select("members", F.lit(None).cast(lists.schema["members"].dataType).alias("others"))
    many = lists.where("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
    many = many.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    a = many.where("chunk = low").select("component", "low", "high", "members")
    b = many.where("chunk = high").select("component", "low", "high", F.col("members").alias("others"))
    met = a.join(b.hint("merge"), ["component", "low", "high"]).select("members", "others")
    search = lambda x: x.mapInArrow(lambda batches: _search(batches, similarity), "src long, dst long")
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_GROUPS))
    found = stored(search(own).union(search(met)), "near-links")
    small_batches(docs.sparkSession)
    return found


def simhash_links(rows: DataFrame) -> DataFrame:
    """(src, dst): links that connect just the classes that chains of near fingerprints connect; rows: node, fp."""
    held = stored(rows.select("node", "fp").distinct(), "near-prints")
    prints = held.select("fp").distinct()
    grouped = components(prints.withColumnRenamed("fp", "node"), simhash.links(prints)).withColumnRenamed("node", "fp")
    mine = stored(held.join(grouped.hint("merge"), "fp").select("node", "component").distinct(), "near-print-groups")
    least = mine.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return mine.join(least.hint("merge"), "component").where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_simhash: bool = False) -> DataFrame:
    """The rows of docs that stay: of each component the row of least (id, text hash), all its columns, once."""
    small_batches(docs.sparkSession)
    keys = F.pandas_udf(_keys, "array<long>")(F.coalesce(F.col(text_col), F.lit("")))
    prints = [simhash.fingerprint(text_col).alias("fp")] if by_simhash else []
    rows = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), keys.alias("keys"), *prints), "near-keys")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash"))
    classes = rows.groupBy(F.get("keys", F.lit(0)).alias("node")).agg(least.alias("least"), F.min("keys").alias("keys"))
    classes = stored(classes.select("node", F.col("least.id").alias("id"), F.col("least.hash").alias("hash"), F.get("keys", F.lit(1)).alias("size"), "keys"), "near-classes")
    found = links(docs, classes, id_col, text_col)
    if by_simhash:
        found = found.union(simhash_links(rows.select(F.get("keys", F.lit(0)).alias("node"), "fp")))
    grouped = components(classes.select("node"), found).join(classes.drop("keys").hint("merge"), "node")
    stay = stored(grouped.groupBy("component").agg(least.alias("k")).select("k.id", "k.hash"), "near-stay")
    return rows_of(docs, stay, id_col, text_col)
