"""Queries over events: as-of, sessions, time buckets, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import temporal
from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query("""
SELECT p.event_id, p.user_id, p.ts, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return temporal.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", ["user_id"], ["view_value"], bucket=lambda ts: F.to_date(ts))


@query("""
SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events))
GROUP BY user_id, session""")
def sessions(spark, sf_dir):
    e = temporal.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600)
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, max(value) AS top
FROM events GROUP BY ALL""")
def hourly(spark, sf_dir):
    return (table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
            .select(F.col("w.start").alias("bucket"), "event_type", "n", "top"))


@query("""
SELECT (props->>'$.k')::BIGINT % 10 AS digit, count(*) AS n FROM events GROUP BY 1""")
def json_path(spark, sf_dir):
    return (table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("long") % 10).alias("digit"))
            .groupBy("digit").agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT o_orderkey, band FROM orders JOIN (VALUES ('low', 0.0, 50000.0), ('mid', 50000.0, 200000.0), ('high', 150000.0, 1e9)) b(band, lo, hi)
ON o_totalprice >= lo AND o_totalprice < hi""")
def range_join(spark, sf_dir):
    bands = spark.sql("SELECT * FROM VALUES ('low', 0.0D, 50000.0D), ('mid', 50000.0D, 200000.0D), ('high', 150000.0D, 1000000000.0D) AS b(band, lo, hi)")
    return temporal.range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "lo", "hi", 1_000_000).select("o_orderkey", "band")
