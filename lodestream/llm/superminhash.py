"""Near-duplicates by SuperMinHash signatures, bands, exact verification and union of the links.

A signature has REGISTERS registers. Each shingle puts a value into each of
them, in the order of a random permutation of its own: rank plus a random
fraction. The ranks of one shingle are thereby correlated (all different), which
makes the share of equal registers a less varying estimate than that of
independent minima, most so for small sets. A value of rank j is j at least, so
once all registers of a document are below j no further rank can lower one, and
its shingles stop; a document of over some 600 shingles is done after rank 0.

Registers are cut into BANDS bands of BAND_ROWS. Documents of equal sets form a
class; classes that share a band are candidates, and each link is then decided
on the full sets (`near_copies.links`: bounded tasks, spanning forests, no cap).
A pair at just 0.85 shares no band with a chance of about one in a million, less
for small sets; `tests/llm/test_superminhash.py` measures it.

Defined cases: a null or wordless text has no set, is linked with nothing and is
a component of its own; fewer than five words make one shingle; repeated rows and
equal texts share a class; a null id is never a component's number, and a row of
null id is kept only where no row of its component has an id; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import near_copies
from lodestream.llm.common import components, small_batches, stored, table

SIMILARITY = 0.85
BANDS, BAND_ROWS = 24, 5
REGISTERS = BANDS * BAND_ROWS
#: Shingles whose ranks are dealt in step: their permutations take REGISTERS bytes each.
_STEP = 8192
_RANK = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_RNG = np.random.default_rng(13)
_ROW_TIMES = _RNG.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_PLUS = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _random(h: np.ndarray, rank: int) -> np.ndarray:
    """64 bits for each shingle and rank."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * (rank + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, sizes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """(sets, registers): rank in the high 32 bits, the random fraction in the low ones. hashes: of all sets, one after the other."""
    least = np.full((len(sizes), registers), np.iinfo(np.uint64).max, np.uint64)
    flat, owners = least.reshape(-1), np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), _STEP):
        h, owner = hashes[at:at + _STEP], owners[at:at + _STEP]
        order, rank = None, 0
        while len(h) and rank < registers:
            x = _random(h, rank)
            drawn = rank + (((x & _LOW) * np.uint64(registers - rank)) >> _RANK).astype(np.int64)
            here = np.arange(len(h))
            if order is None:  # nothing has been swapped yet
                place = drawn
            else:
                place = order[here, drawn].astype(np.int64)
                order[here, drawn] = order[here, rank]
            np.minimum.at(flat, owner * registers + place, (np.uint64(rank) << _RANK) | (x >> _RANK))
            rank += 1
            first, last = owner[0], owner[-1]
            open_sets = least[first:last + 1].max(axis=1) >= np.uint64(rank) << _RANK
            more = open_sets[owner - first]
            if order is None:
                order = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.int32), (int(more.sum()), 1))
                order[np.arange(len(order)), drawn[more]] = 0
            elif not more.all():
                order = order[more]
            if not more.all():
                h, owner = h[more], owner[more]
    return least


def keys_of(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted set of hashes: hash of the set, its size and its bands; of an empty set only (0, 0)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    found = signatures(np.concatenate(sets) if sets else np.empty(0, np.uint64), sizes)
    bands = near_copies._mixed((found.reshape(-1, BANDS, BAND_ROWS) * _ROW_TIMES).sum(axis=2, dtype=np.uint64) + _BAND_PLUS)
    return [np.concatenate([np.array([xxhash.xxh64_intdigest(s.tobytes()), len(s)], np.uint64), b]).view(np.int64) if len(s) else np.zeros(2, np.int64)
            for s, b in zip(sets, bands)]


def _keys(texts: pd.Series) -> pd.Series:
    return pd.Series(keys_of([near_copies.shingles(t or "") for t in texts]), dtype=object)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of each row; component_id the smallest id reachable."""
    small_batches(docs.sparkSession)
    keys = F.pandas_udf(_keys, "array<long>")(F.coalesce(F.col(text_col), F.lit("")))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), keys.alias("keys")), "smh-keys")
    rows = rows.select("id", "hash", F.get("keys", F.lit(0)).alias("set"), F.get("keys", F.lit(1)).alias("size"), "keys")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash"))
    classes = rows.where("size > 0").groupBy(F.col("set").alias("node")).agg(least.alias("least"), F.min("size").alias("size"), F.min("keys").alias("keys"))
    classes = stored(classes.select("node", F.col("least.id").alias("id"), F.col("least.hash").alias("hash"), "size", "keys"), "smh-classes")
    found = near_copies.links(docs, classes, id_col, text_col, similarity)
    grouped = stored(components(classes.select("node"), found).join(classes.select("node", "id").hint("merge"), "node"), "smh-grouped")
    numbers = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    of_set = grouped.join(numbers.hint("merge"), "component").select("node", "component_id")
    # both sides grow with the corpus: always merged, never broadcast; a set of many copies is split by AQE
    joined = rows.drop("keys").join(of_set.hint("merge"), rows["set"] == F.col("node"), "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), F.col("size").alias("n_shingles"),
                         F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op13_superminhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


_OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1),
    lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM t WHERE len(w) > 0),
c AS MATERIALIZED (SELECT sh, len(sh) AS n, row_number() OVER (ORDER BY min(r)) AS node FROM s GROUP BY sh),
of_set AS MATERIALIZED (SELECT s.r, s.doc_id, c.node, c.n FROM s JOIN c ON s.sh = c.sh),
g AS MATERIALIZED (SELECT node, n, unnest(sh) AS h FROM c),
p AS (SELECT a.node AS x, b.node AS y, count(*) AS i, min(a.n + b.n) AS total
      FROM g a JOIN g b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * i >= 85 * (total - i) UNION ALL SELECT y, x FROM p WHERE 100 * i >= 85 * (total - i)),
reach(node, other) AS (SELECT node, node FROM c UNION SELECT reach.node, l.y FROM reach JOIN l ON reach.other = l.x),
m AS (SELECT reach.node, min(o.doc_id) AS component_id FROM reach JOIN of_set o ON o.node = reach.other GROUP BY 1)
SELECT t.doc_id, coalesce(o.n, 0) AS n_shingles, CASE WHEN o.n IS NULL THEN t.doc_id ELSE m.component_id END AS component_id,
       t.doc_id IS NOT DISTINCT FROM CASE WHEN o.n IS NULL THEN t.doc_id ELSE m.component_id END AS kept
FROM t LEFT JOIN of_set o ON t.r = o.r LEFT JOIN m ON m.node = o.node
"""

QUERIES = {"op13_superminhash": op13_superminhash}
ORACLE_SQL = {"op13_superminhash": _OP13_SQL}
