"""Queries of group frames, co-partitioned tables and table functions, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import udtfs
from lodestream.operators.frames import groups_frame
from lodestream.plans.registry import query
from lodestream.sources.bucketed import write_bucketed
from lodestream.sources.tables import table


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity,
  sum(l_tax::DECIMAL(8,2)) OVER (w GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::DECIMAL(18,2) AS near_tax,
  count(*) OVER (w GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near_rows
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""")
def groups_between(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.col("l_tax").cast("decimal(8,2)").alias("tax"))
    found = groups_frame(li, ["l_suppkey"], {"l_quantity": True}, {"near_tax": ("sum", "tax"), "near_rows": ("count", F.lit(1))}, -2, 1)
    return found.withColumn("near_tax", F.col("near_tax").cast("decimal(18,2)")).drop("tax")


@query("""
SELECT event_id, max(value) OVER (w GROUPS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE GROUP) AS others_top,
  count(value) OVER (w GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts::DATE DESC)""")
def groups_without_peers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    near = groups_frame(e, ["event_type"], {"day": False}, {"others_top": ("max", "value")}, -3, 3, without_peers=True)
    return groups_frame(near, ["event_type"], {"day": False}, {"so_far": ("count", "value")}, None, 0).select("event_id", "others_top", "so_far")


@query("""
SELECT o_orderkey, o_custkey, count(*) AS n, sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS total, max(l_shipdate) AS last_ship
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def bucketed_join(spark, sf_dir):
    """Orders and their lines, both bucketed by order: joined and grouped without a shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = spark.table(write_bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], buckets))
    li = spark.table(write_bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate"), ["l_orderkey"], buckets))
    return o.join(li.hint("merge"), o.o_orderkey == li.l_orderkey).groupBy("o_orderkey", "o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"), F.max("l_shipdate").alias("last_ship"))


@query("""
WITH RECURSIVE o AS MATERIALIZED (
  SELECT o_orderkey, o_custkey, round(o_totalprice)::BIGINT AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
b AS (
  SELECT o_orderkey, o_custkey, r, 0::BIGINT AS batch, price AS filled FROM o WHERE r = 1
  UNION ALL SELECT o.o_orderkey, o.o_custkey, o.r, CASE WHEN b.filled + o.price > 600000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.filled + o.price > 600000 THEN o.price ELSE b.filled + o.price END
  FROM b JOIN o ON o.o_custkey = b.o_custkey AND o.r = b.r + 1)
SELECT o_orderkey, batch, filled FROM b""")
def table_function(spark, sf_dir):
    """A customer's orders, by date, packed into batches of up to 600,000."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.floor(F.col("o_totalprice") + 0.5).alias("price"))
    return udtfs.packed(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "price", 600_000).select("o_orderkey", "batch", "filled")


@query("""
SELECT p_brand, count(*) AS n, true AS distinct_close FROM part GROUP BY p_brand""")
def approximate_distinct(spark, sf_dir):
    """Built-in approximate distinct counts of each brand's prices, within three times the standard deviation that is asked for, or two."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("p_retailprice", 0.05).alias("a"), F.count_distinct("p_retailprice").alias("d"))
    return p.select("p_brand", "n", (F.abs(F.col("a") - F.col("d")) <= F.greatest(F.lit(2.0), 0.15 * F.col("d"))).alias("distinct_close"))


_CODES = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
_SOUNDS = "".join(d * len(letters) for d, letters in _CODES.items())
_LETTERS = "".join(_CODES.values())


@query(f"""
WITH c AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([A-Za-z]+)', 1)) AS w FROM pages),
l AS (SELECT page_id, w, translate(regexp_replace(w, '[hw]', '', 'g'), '{_LETTERS}aeiouy', '{_SOUNDS}000000') AS d FROM c WHERE w <> ''),
s AS (SELECT page_id, w, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS d FROM l)
SELECT page_id, rpad(substr(upper(w), 1, 1) || substr(replace(CASE WHEN substr(w, 1, 1) IN ('h', 'w') THEN d ELSE substr(d, 2) END, '0', ''), 1, 3), 4, '0') AS sound FROM s""")
def sounds(spark, sf_dir):
    """Soundex of each host's first letters."""
    first = F.regexp_extract("url", "^[a-z]+://([A-Za-z]+)", 1)
    return table(spark, sf_dir, "pages").where(first != "").select("page_id", F.soundex(first).alias("sound"))


@query("""
SELECT doc_id, len(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' '))))::INTEGER AS pieces,
  array_to_string(list_sort(map_values(MAP {'lang': lang, 'source': source})), ' ') AS named
FROM documents""")
def nested_arrays(spark, sf_dir):
    words = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    named = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.flatten(words)).alias("pieces"), F.array_join(F.array_sort(F.map_values(named)), " ").alias("named"))
