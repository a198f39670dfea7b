"""Benchmark decontamination by SimHash of item-sized windows.

An item matches a window of a document, as many words long as the item, if the
multisets of their five-word shingles have a weighted Jaccard similarity of
SIMILARITY or more. Windows and items are fingerprinted: the majority of each bit
over the 64-bit hashes of the shingles, repeats counted. Fingerprints are found
by multi-index blocks: 64 bits in RADIUS + 1 blocks, so that two fingerprints
within the radius agree in a whole block, and blocks are joined together with
the window size. Candidates within the radius are verified by the exact weighted
similarity of their shingles.

Every size that an item has is a window size of its own. With a radius of RADIUS
blocks are about three bits wide and filter little by themselves, so items are
dealt to CLASSES classes, which are a part of the join's key, and only windows
that can match are fingerprinted: a window of m shingles needs at least
SIMILARITY * m shingles of items of the class. A table of masks, of the classes
that each hashed shingle occurs in, tells that; it has 2 ** SLOT_BITS entries to
2 ** MOST_SLOT_BITS as the items need, and a wrong hit only costs a fingerprint.

The radius isn't a full guarantee: two equal shares of 0.8 differ in about ten
bits with a deviation of three, so a pair beyond it is missed with a chance of
about one in a thousand at just 0.8 (tests measure it), and next to none above.

Defined cases: null and wordless texts, and such items, match nothing; texts
shorter than a window are one window; with fewer than five words all words are
one shingle; rows of one id are reported together, a null id like any other;
repeated items are reported under each of their ids; equal matches give the
first place; empty tables give no rows; other columns are ignored by
`contaminated` and kept, whatever their names, by `clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import small_batches, stored, table, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which a window's fingerprint may differ: at a similarity of 0.8 about ten do, with a deviation of three.
RADIUS = 20
#: log2 of the entries of the table of masks, at least and at most; a mask has a bit for each class.
SLOT_BITS, MOST_SLOT_BITS = 22, 24
CLASSES = 64
_CACHE = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WINDOWS = "d_id long, start int, size int, class int, fp long, shingles array<bigint>"
_ITEMS = "i_id long, size int, class int, fp long, hashes array<bigint>, shingles array<bigint>"


class _Hashes(dict):
    def __missing__(self, word):
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every `shingle` words in a row; of all words, if there are fewer."""
    n = len(word_hashes)
    k = min(shingle, n)
    out = np.zeros(max(0, n - k + 1) if n else 0, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + word_hashes[i:i + len(out)]
    return _mixed(out + np.uint64(k))


def majority(h: np.ndarray) -> int:
    """SimHash of shingle hashes, as a signed long."""
    ones = np.unpackbits(np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def numbered(h: np.ndarray) -> np.ndarray:
    """The multiset as a set: the kth occurrence of a hash gets a value of its own."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return _mixed(s + nth.astype(np.uint64) * _MULTIPLIER).view(np.int64)


def _hashed(text, cache) -> np.ndarray:
    ws = words(text)
    if len(cache) > _CACHE:
        cache.clear()
    return np.fromiter((cache[w] for w in ws), np.uint64, len(ws))


def _items(batches):
    cache = _Hashes()
    for batch in batches:
        rows = []
        for i, t in zip(batch.column("i_id").to_pylist(), batch.column("text").to_pylist()):
            h = _hashed(t or "", cache)
            if len(h):
                s = shingle_hashes(h)
                rows.append((i, len(h), xxhash.xxh64_intdigest(s.tobytes()) % CLASSES, majority(s), s.view(np.int64), numbered(s)))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()),
             *(pa.array(list(c), pa.list_(pa.int64())) for c in columns[4:])],
            names=["i_id", "size", "class", "fp", "hashes", "shingles"])


def _slot_masks(items: DataFrame) -> np.ndarray:
    """For each slot the classes of the item shingles there."""
    n = items.agg(F.sum(F.size("hashes"))).first()[0] or 0
    bits = min(MOST_SLOT_BITS, max(SLOT_BITS, int(n).bit_length() + 4))
    slots = items.select(F.explode("hashes").alias("h"), F.expr("shiftleft(1L, class)").alias("m"))
    merged = slots.groupBy((F.col("h").bitwiseAND(F.lit((1 << bits) - 1))).alias("slot")).agg(F.bit_or("m").alias("m"))
    packed = merged.groupBy((F.col("slot") / F.lit(1 << 12)).cast("int").alias("part")).agg(F.collect_list("slot").alias("slots"), F.collect_list("m").alias("masks"))
    out = np.zeros(1 << bits, np.uint64)
    for r in packed.toLocalIterator():
        out[np.array(r.slots, np.int64)] = np.array(r.masks, np.int64).view(np.uint64)
    return out


def candidate_windows(h: np.ndarray, masks: np.ndarray, sizes: dict[int, np.ndarray], least: float = SIMILARITY):
    """(start, size, class, shingles) of each window that can match; h: word hashes of a text, sizes: of the items of each class."""
    for k in sorted({min(SHINGLE, s) for c in sizes.values() for s in c[:SHINGLE].tolist()}):  # windows of fewer words are one shingle
        s = shingle_hashes(h, k)
        if not len(s):
            continue
        hit = masks[(s & np.uint64(len(masks) - 1)).astype(np.intp)]
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        often = ((hit[at, None] >> np.arange(CLASSES, dtype=np.uint64)) & np.uint64(1)).sum(axis=0, dtype=np.int64)
        for c in np.flatnonzero(often).tolist():
            mine = sizes.get(c, np.empty(0, np.int64))
            mine = mine[np.minimum(mine, SHINGLE) == k]
            m = np.maximum(1, np.minimum(mine, len(h)) - k + 1)
            fit = often[c] >= least * m - 1e-9
            if not fit.any():
                continue
            total = np.zeros(len(s) + 1, np.int32)
            np.cumsum((hit >> np.uint64(c)) & np.uint64(1), out=total[1:])
            for size, m in zip(mine[fit].tolist(), m[fit].tolist()):
                for start in np.flatnonzero(total[m:] - total[:len(s) + 1 - m] >= least * m - 1e-9).tolist():
                    yield start, size, c, s[start:start + m]


def _windows(batches, shared):
    (masks, sizes), cache = shared.value, _Hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for i, t in zip(part.column("d_id").to_pylist(), part.column("text").to_pylist()):
                if t:
                    rows += [(i, start, size, c, majority(s), numbered(s)) for start, size, c, s in candidate_windows(_hashed(t, cache), masks, sizes)]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:4]), pa.array(columns[4], pa.int64()),
                 pa.array(list(columns[5]), pa.list_(pa.int64()))],
                names=["d_id", "start", "size", "class", "fp", "shingles"])


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row for each block: its number and its bits."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    bits = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return df.select("*", F.posexplode(F.array(*bits)).alias("block", "bits"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id_col, item_col, similarity, first_word, n_words): the best window of each document for each item that it holds."""
    small_batches(docs.sparkSession)
    known = items.select(F.col(item_col).cast("long").alias("i_id"), F.col(item_text_col).alias("text"))
    known = stored(known.mapInArrow(_items, _ITEMS), "items")
    sizes: dict[int, list] = {}
    for size, c in sorted(known.select("size", "class").distinct().collect()):
        sizes.setdefault(c, []).append(size)
    sizes = {c: np.array(x, np.int64) for c, x in sizes.items()}
    shared = docs.sparkSession.sparkContext.broadcast((_slot_masks(known), sizes))
    rows = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("text"))
    found = stored(rows.mapInArrow(lambda b: _windows(b, shared), _WINDOWS), "windows")

    w = _blocks(found.select("size", "class", "fp").distinct(), radius)
    i = _blocks(known.select("size", "class", "fp", "i_id"), radius).withColumnRenamed("fp", "i_fp")
    near = (w.join(i, ["size", "class", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp"))) <= radius)
            .select("size", "class", "fp", "i_id", "i_fp").distinct())
    theirs = known.select("i_id", "size", "class", F.col("fp").alias("i_fp"), F.col("shingles").alias("i_shingles"))
    checked = found.join(near, ["size", "class", "fp"]).join(theirs, ["i_id", "size", "class", "i_fp"])
    both = F.size(F.array_intersect("shingles", "i_shingles"))
    checked = checked.withColumn("similarity", both / (F.size("shingles") + F.size("i_shingles") - both)).where(F.col("similarity") >= similarity - 1e-9)
    best = checked.groupBy("d_id", "i_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("b"))
    return best.select(F.col("d_id").alias(id_col), F.col("i_id").alias(item_col), "b.similarity", (-F.col("b.back")).alias("first_word"), F.col("b.size").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no item, all their columns."""
    hit = stored(contaminated(docs, items, id_col).select(F.col(id_col).alias("dc_id")).distinct(), "contaminated")
    keyed = docs.select(docs[f"`{id_col}`"].cast("long").alias("dc_of"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("dc_row"))
    return keyed.join(hit, F.col("dc_of").eqNullSafe(F.col("dc_id")), "left_anti").select(*(F.col("dc_row")[c].alias(c) for c in docs.columns))


def op5_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: The exact similarity of every window that shares a shingle with an item, without fingerprints; items of SHINGLE words or more.
_OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
t AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
ds AS (SELECT doc_id, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s, len(w) AS n FROM d, generate_series(1, len(w) - {SHINGLE - 1}) AS g(i)),
ts AS (SELECT item_id, j, array_to_string(w[j:j + {SHINGLE - 1}], ' ') AS s, len(w) AS n FROM t, generate_series(1, len(w) - {SHINGLE - 1}) AS g(j)),
tn AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id, s ORDER BY j) AS nth FROM ts),
places AS (
  SELECT DISTINCT doc_id, item_id, a, ts.n, least(ts.n, ds.n) - {SHINGLE - 1} AS m
  FROM ds JOIN ts ON ds.s = ts.s, generate_series(greatest(1, i - least(ts.n, ds.n) + {SHINGLE}), least(i, ds.n - least(ts.n, ds.n) + 1)) AS g(a)),
windows AS (
  SELECT p.doc_id, p.item_id, a, p.n, m, ds.s, row_number() OVER (PARTITION BY p.doc_id, p.item_id, a, ds.s ORDER BY i) AS nth
  FROM places p JOIN ds ON ds.doc_id = p.doc_id AND i BETWEEN a AND a + m - 1),
shared AS (
  SELECT doc_id, w.item_id, a, n, m, count(tn.s) AS hits
  FROM windows w LEFT JOIN tn ON w.item_id = tn.item_id AND w.s = tn.s AND w.nth = tn.nth GROUP BY ALL),
rated AS (SELECT *, hits::DOUBLE / (m + n - {SHINGLE - 1} - hits) AS similarity FROM shared),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) AS r FROM rated WHERE similarity >= {SIMILARITY} - 1e-9)
SELECT doc_id, item_id, similarity, (a - 1)::INTEGER AS first_word, n::INTEGER AS n_words FROM best WHERE r = 1
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL = {"op5_decontaminate": _OP5_SQL}
