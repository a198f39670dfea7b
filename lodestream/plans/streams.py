"""Queries that run as streams over events, and round trips through files, with SQL of the rows they end with.

A stream reads what is there and stops. Windows that the watermark hasn't passed
stay open and give no rows, which the SQL says too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestream.plans.registry import query
from lodestream.sources import files
from lodestream.sources.shared import new_path
from lodestream.sources.tables import table
from lodestream.streaming import state, windows


def _events(spark, sf_dir):
    # a pattern, as the table can be one file, which isn't a folder to stream from
    return windows.read_events(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", table(spark, sf_dir, "events"))


def _ended(spark, stream):
    out = new_path(spark, "stream")
    windows.run_to_end(stream, out, new_path(spark, "stream-state"))
    return spark.read.schema(stream.schema).parquet(out)


def _plain_time(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("""
SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY start, event_type""")
def stream_tumbling(spark, sf_dir):
    return _plain_time(_ended(spark, windows.windowed_counts(_events(spark, sf_dir), "1 hour", "2 hours")), "start")


@query("""
SELECT start, count(*) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts - INTERVAL 1 HOUR) + INTERVAL 1 HOUR]) AS start FROM events)
GROUP BY start HAVING start + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_sliding(spark, sf_dir):
    return _plain_time(_ended(spark, windows.sliding_counts(_events(spark, sf_dir), "2 hours", "1 hour", "2 hours")), "start")


@query("""
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    return _plain_time(_ended(spark, windows.session_counts(_events(spark, sf_dir), "user_id", "6 hours", "2 hours")), "start", "end")


@query("""
SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR""")
def stream_stream_join(spark, sf_dir):
    views, purchases = (_events(spark, sf_dir).where(F.col("event_type") == kind) for kind in ("view", "purchase"))
    return _ended(spark, windows.followed(views, purchases, "user_id", "12 HOUR", "2 hours"))


@query("SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_static_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return _ended(spark, windows.with_lookup(_events(spark, sf_dir), customers, "user_id")).select("event_id", "user_id", "c_mktsegment")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    """The first event of each user and type, all within one batch."""
    return _ended(spark, windows.first_of_each(_events(spark, sf_dir), ["user_id", "event_type"], "2 hours")).select("user_id", "event_type")


_STORE = "spark.sql.streaming.stateStore.providerClass"


@query("""
WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events)),
v AS (SELECT user_id, s, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT user_id, s, string_agg(event_type || ':' || k, ',' ORDER BY event_type) AS items FROM (SELECT user_id, s, event_type, count(*) AS k FROM s GROUP BY ALL) GROUP BY ALL)
SELECT user_id::VARCHAR AS key, date_trunc('milliseconds', first) AS first, date_trunc('milliseconds', last) AS last, n, items FROM v JOIN i USING (user_id, s)
WHERE last + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) OR s < (SELECT max(m.s) FROM v m WHERE m.user_id = v.user_id)""")
def stream_visits(spark, sf_dir):
    """Users' visits by a state of our own, whose event-time timers end those that no event ends."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = _ended(spark, state.visits(_events(spark, sf_dir), "user_id", "event_type", "value", 8 * 3600, "2 hours"))
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return _plain_time(found, "first", "last").drop("total")


@query("""
SELECT format, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS total, max(o_orderdate) AS last
FROM orders, (VALUES ('csv'), ('json'), ('orc'), ('parquet'), ('xml')) AS f(format) GROUP BY format""")
def file_formats(spark, sf_dir):
    """Orders written in each format and read again."""
    orders, sums = table(spark, sf_dir, "orders"), []
    for kind in sorted(files.FORMATS):
        path = new_path(spark, kind)
        files.write(orders, path, kind)
        sums.append(files.read(spark, path, kind, orders.schema).agg(
            F.lit(kind).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"),
            F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"), F.max("o_orderdate").alias("last")))
    return reduce(lambda a, b: a.unionByName(b), sums)


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def partitioned_files(spark, sf_dir):
    """Orders in a folder for each status, of which one is read."""
    path = new_path(spark, "by-status")
    files.write(table(spark, sf_dir, "orders"), path, "parquet", by=["o_orderstatus"])
    return files.read(spark, path, "parquet").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("SELECT md5(text) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY text")
def text_files(spark, sf_dir):
    """Documents' lines written as text files and read again."""
    path = new_path(spark, "lines")
    files.write_lines(table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")), path)
    return files.lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.md5("value").alias("line_md5"), "n")
