"""Queries that run user-defined functions, with the SQL of the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestream.functions import udfs
from lodestream.operators import grouped
from lodestream.plans.registry import query
from lodestream.sources.tables import table

_PLAIN = "SELECT doc_id, md5(nfc_normalize(strip_accents(text))) AS plain_md5 FROM documents"


@query(_PLAIN)
def udf_by_row(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(udfs.plain_by_row()("text")).alias("plain_md5"))


@query(_PLAIN)
def udf_by_arrow(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(udfs.plain_by_arrow()("text")).alias("plain_md5"))


@query("SELECT event_id, least(greatest(value, 0), 100)::DOUBLE AS clipped FROM events")
def pandas_udf(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", udfs.clipped()("value").alias("clipped"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents")
def arrow_udf(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", udfs.byte_length()("text").alias("n_bytes"))


@query("""
SELECT l_suppkey, l_returnflag, round(mad(l_extendedprice), 4) AS deviation FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def udaf(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(udfs.median_deviation()("l_extendedprice"), 4).alias("deviation"))


@query("SELECT page_id, unnest(string_split(url, '/')) AS part, (generate_subscripts(string_split(url, '/'), 1) - 1)::INTEGER AS place FROM pages")
def udtf(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.lateralJoin(udfs.pieces()(F.col("url").outer(), F.lit("/"))).select("page_id", "part", "place")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
SELECT o_orderkey, floor(100 * (0.0000371828182 + pow(0.7, r) * sum((CASE WHEN r = 1 THEN 1.0 ELSE 0.3 END) * o_totalprice / pow(0.7, r)) OVER (PARTITION BY o_custkey ORDER BY r)))::BIGINT AS cents FROM o""")
def apply_in_pandas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return grouped.smoothed(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "level", 0.3).select(
        "o_orderkey", F.floor(100 * (F.lit(0.0000371828182) + F.col("level"))).alias("cents"))  # off all ties


@query("""
WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL),
p AS (SELECT p.user_id, p.ts, b.ts AS b_ts, b.value AS b_value, a.ts AS a_ts, a.value AS a_value
  FROM (SELECT * FROM events WHERE event_type = 'error') p
  ASOF LEFT JOIN c b ON p.user_id = b.user_id AND p.ts >= b.ts ASOF LEFT JOIN c a ON p.user_id = a.user_id AND p.ts <= a.ts)
SELECT user_id, ts, CASE WHEN b_ts IS NOT NULL AND (a_ts IS NULL OR ts - b_ts <= a_ts - ts) THEN CASE WHEN ts - b_ts <= INTERVAL 12 HOUR THEN b_value END
  WHEN a_ts - ts <= INTERVAL 12 HOUR THEN a_value END AS value FROM p""")
def cogrouped(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return grouped.nearest(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "ts", "user_id", "value", pd.Timedelta(hours=12))


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 60")
def map_in_arrow(spark, sf_dir):
    return grouped.without_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", 10.0, 60.0)
