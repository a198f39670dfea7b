"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n rows and target weight w gets the mean repetition rate
total * w / n. Each row draws a count from the Poisson distribution with that
mean by inversion, at a point that an MD5 of seed and id gives, is exploded by
its count, and all copies are shuffled by another MD5. The same seed and ids
give the same mixture on any cluster.

A rate of over PIECE is the sum of equal rates of at most PIECE, each with its
own draw, so no distribution table has over TERMS entries. The table of rates
(one row a source) is written first: Spark broadcasts it only if its measured
size is under the session's limit, else it shuffles and splits hot sources.

Defined cases: a null source is a source of its own; a null id hashes as empty
text; rows with equal ids get equal counts; a source without a weight (or with a
weight of zero, or null) is left out when weights are given; texts are not
looked at, so null, empty and long ones pass; all columns are kept, whatever their
names, but those named as out_copy and out_key, which are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import stored, table

PIECE, TERMS = 16.0, 96
SEED = 20240501


def _uniform(seed: int, *parts):
    """In (0, 1), from 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def target_rates(docs: DataFrame, source_col: str, weights: DataFrame | None = None, total: float | None = None, power: float = 0.5) -> DataFrame:
    """(mix_source, mix_rate, mix_pieces, mix_cdf) of each source. weights: (source, weight); else count ** power."""
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.sum("weight").cast("double").alias("w"))
        weighed = counts.join(given, F.col("mix_source").eqNullSafe(F.col("s"))).drop("s").where("w > 0")
    weighed = stored(weighed, "mix-counts")
    sums = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(total if total is not None else sums.n or 0)
    rate = F.lit(wanted) * F.col("w") / F.lit(sums.w or 1.0) / F.col("n")
    rates = weighed.select("mix_source", rate.alias("mix_rate")).withColumn("mix_pieces", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PIECE)).cast("int"))
    first = F.exp(-F.col("mix_rate") / F.col("mix_pieces"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * F.col("mix_rate") / F.col("mix_pieces") / k).alias("p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("mix_rate") / F.col("mix_pieces") / k)).alias("cdf")))
    return stored(rates.withColumn("mix_cdf", terms["cdf"]), "mix-rates")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None,
        total: float | None = None, power: float = 0.5, seed: int = SEED,
        out_copy: str = "copy", out_key: str = "shuffle_key") -> DataFrame:
    """docs, each row as often as its draw says, with out_copy (from 1) and out_key, globally shuffled by out_key."""
    rates = target_rates(docs, source_col, weights, total, power)
    # a row in one struct: the caller's names stay out of the way
    d = docs.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source_of"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("mix_row"))
    joined = d.join(rates, F.col("mix_source_of").eqNullSafe(F.col("mix_source")))
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_pieces")), F.lit(0),
        lambda n, i: n + F.size(F.filter("mix_cdf", lambda c: c <= _uniform(seed, F.col("mix_id"), i))))
    copies = joined.select("mix_id", "mix_row", draws.alias("mix_n")).where("mix_n > 0")
    copies = copies.select("mix_id", "mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("mix_copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.coalesce(F.col("mix_id").cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
    kept = [F.col("mix_row")[c].alias(c) for c in docs.columns if c.lower() not in (out_copy.lower(), out_key.lower())]
    return copies.select(*kept, F.col("mix_copy").alias(out_copy), key.alias(out_key)).repartition(F.col(f"`{out_key}`")).sortWithinPartitions(f"`{out_key}`")


def op3_poisson_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


_OP3_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(n)) AS w, sum(n)::DOUBLE AS total FROM n),
r AS (SELECT source, rate, greatest(1, ceil(rate / {PIECE}))::INTEGER AS pieces
      FROM (SELECT source, total * sqrt(n.n) / w / n.n AS rate FROM n, t)),
p AS (SELECT source, k, exp(-rate / pieces + k * ln(rate / pieces) - lgamma(k + 1)) AS p
      FROM r, generate_series(0, {TERMS}) AS g(k)),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM
      (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p) GROUP BY source),
u AS (SELECT doc_id, d.source, i, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source, generate_series(1, r.pieces) AS g(i)),
m AS (SELECT doc_id, sum(len(list_filter(cdf, lambda x: x <= u)))::INTEGER AS n
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY doc_id)
SELECT d.*, copy::INTEGER AS copy, md5('{SEED}s:' || coalesce(d.doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM documents d JOIN m ON d.doc_id IS NOT DISTINCT FROM m.doc_id, generate_series(1, m.n) AS g(copy)
"""

QUERIES = {"op3_poisson_mix": op3_poisson_mix}
ORACLE_SQL = {"op3_poisson_mix": _OP3_SQL}
