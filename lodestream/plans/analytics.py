"""Queries of filters, subqueries, statistics, windows and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS twice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount > 0.05")
def project_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' AND l_shipdate < timestamp_ntz'1997-01-01' AND l_discount > 0.05D")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 2).alias("twice"))


@query("""
SELECT p_partkey, p_name FROM part
WHERE p_size BETWEEN 5 AND 25 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND p_type LIKE '%E%' AND NOT p_name LIKE '%zzz%'""")
def predicates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(p.p_size.between(5, 25) & p.p_brand.isin("Brand#11", "Brand#12", "Brand#23", "Brand#34") & p.p_type.like("%E%") & ~p.p_name.like("%zzz%")).select("p_partkey", "p_name")


@query("""
SELECT count(*) AS n, count(*) FILTER (a IS NOT DISTINCT FROM b) AS same, count(*) FILTER (a = b) AS equal, count(*) FILTER (a IS NULL) AS absent
FROM (SELECT nullif(o_orderstatus, 'F') AS a, nullif(o_orderstatus, 'O') AS b FROM orders)""")
def null_safe_equality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderstatus", F.lit("O")).alias("b"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("a").isNull()).alias("absent"))


@query("""
SELECT c_mktsegment, o_orderstatus, count(*) AS n, count(*) FILTER (late) AS n_late FROM (
  SELECT c_mktsegment, o_orderstatus, l_shipdate > o_orderdate + INTERVAL 60 DAY AS late
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 100000)
GROUP BY ALL HAVING count(*) > 10 UNION ALL SELECT 'none', o_orderstatus, count(*), 0 FROM orders GROUP BY o_orderstatus""")
def pipe_syntax(spark, sf_dir):
    """Joins, a computed column, an aggregate, a filter on it and a union, each step piped to the next."""
    o, c, li = (table(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    return spark.sql("""
        FROM {o} |> WHERE o_totalprice > 100000 |> JOIN {c} ON c_custkey = o_custkey |> JOIN {li} ON l_orderkey = o_orderkey
        |> EXTEND l_shipdate > o_orderdate + INTERVAL 60 DAY AS late
        |> AGGREGATE count(*) AS n, count_if(late) AS n_late GROUP BY c_mktsegment, o_orderstatus
        |> WHERE n > 10
        |> UNION ALL (FROM {o} |> AGGREGATE count(*) AS n GROUP BY o_orderstatus |> SELECT 'none' AS c_mktsegment, o_orderstatus, n, 0L AS n_late)""", o=o, c=c, li=li)


@query("SELECT r_name, o_orderpriority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)")
def join_cross(spark, sf_dir):
    """Two sides whose sizes don't grow with the data: regions, and the priorities there are."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "orders").select("o_orderpriority").distinct())


@query("""
SELECT o_orderkey, o_totalprice FROM orders o
WHERE o_totalprice > 2 * (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def correlated_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} AS a WHERE o_totalprice > 2 * (SELECT avg(b.o_totalprice) FROM {o} AS b WHERE b.o_custkey = a.o_custkey)", o=o)


@query("SELECT n_name, (SELECT max(c_acctbal) FROM customer) AS most FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def scalar_subquery(spark, sf_dir):
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    poor = s.where("s_acctbal < 0").select("s_nationkey")
    return n.join(poor, n.n_nationkey == poor.s_nationkey, "left_anti").select("n_name", c.select(F.max("c_acctbal")).scalar().alias("most"))


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""")
def lateral_limit(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return spark.sql("""SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM {c}, LATERAL (
      SELECT o_orderkey, o_totalprice FROM {o} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS x""", c=c, o=o)


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS closed, (sum(o_totalprice::DECIMAL(12,2)) FILTER (o_orderstatus = 'O'))::DECIMAL(22,2) AS open_value,
  round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL""")
def filtered_aggregates(spark, sf_dir):
    return spark.sql("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed,
      CAST(sum(CAST(o_totalprice AS decimal(12,2))) FILTER (WHERE o_orderstatus = 'O') AS decimal(22,2)) AS open_value, round(avg(o_totalprice), 4) AS mean FROM {o} GROUP BY ALL""", o=table(spark, sf_dir, "orders"))


@query("""
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r,
  round(covar_pop(l_quantity, l_discount), 6) AS cp, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis_pop(l_extendedprice), 6) AS kurt FROM lineitem GROUP BY l_returnflag""")
def statistics(spark, sf_dir):
    n = F.count("l_extendedprice")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness("l_extendedprice")  # of the sample
    six = lambda c, name: F.round(c, 6).alias(name)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        six(F.stddev_samp("l_quantity"), "sd"), six(F.var_pop("l_quantity"), "vp"), six(F.corr("l_quantity", "l_extendedprice"), "r"),
        six(F.covar_pop("l_quantity", "l_discount"), "cp"), six(skew, "skew"), six(F.kurtosis("l_extendedprice"), "kurt"))


@query("""
SELECT o_orderpriority, median(o_totalprice) AS mid, quantile_cont(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.25) AS q1, mode(o_orderstatus) AS usual FROM orders GROUP BY o_orderpriority""")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.median("o_totalprice").alias("mid"), F.percentile("o_totalprice", 0.9).alias("p90"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice)").alias("q1"), F.mode("o_orderstatus").alias("usual"))


@query("""
SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_dear, bool_or(o_orderstatus = 'P') AS any_open, bit_and(o_orderkey) AS b_and, bit_or(o_orderkey) AS b_or, bit_xor(o_orderkey) AS b_xor FROM orders GROUP BY o_custkey""")
def bool_and_bit_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_and(F.col("o_totalprice") > 1000).alias("all_dear"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"),
        F.bit_and("o_orderkey").alias("b_and"), F.bit_or("o_orderkey").alias("b_or"), F.bit_xor("o_orderkey").alias("b_xor"))


@query("""
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderdate DESC, o_orderkey) AS orders, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities
FROM orders GROUP BY o_custkey""")
def list_aggregate(spark, sf_dir):
    """A customer's orders, the newest first, and the priorities they have had."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.expr("listagg(CAST(o_orderkey AS STRING), ', ') WITHIN GROUP (ORDER BY o_orderdate DESC, o_orderkey)").alias("orders"),
        F.expr("listagg(DISTINCT o_orderpriority, '|') WITHIN GROUP (ORDER BY o_orderpriority)").alias("priorities"))


@query("SELECT least(greatest(floor((l_extendedprice - 0) / 10000) + 1, 0), 11)::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.width_bucket("l_extendedprice", F.lit(0.0), F.lit(100000.0), F.lit(10)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER t AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 500)), t AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def rankings(spark, sf_dir):
    w, t = Window.partitionBy("c_nationkey").orderBy(F.floor(F.col("c_acctbal") / 500)), Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(t).cast("long").alias("quarter"),
        F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("""
SELECT event_id, lead(ts, 1) OVER w AS next_ts, first_value(value) OVER w AS first_value, nth_value(value, 3) OVER w AS third,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.lead("ts").over(w).alias("next_ts"), F.first("value").over(w).alias("first_value"), F.nth_value("value", 3).over(w).alias("third"), F.last(bought, ignorenulls=True).over(w).alias("last_purchase"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_a_day,
  max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 HOUR FOLLOWING) AS most FROM events""")
def interval_frames(spark, sf_dir):
    return spark.sql("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_a_day,
      max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING) AS most FROM {e}""", e=table(spark, sf_dir, "events"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 10")
def offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(10).limit(15)


@query("SELECT c_nationkey AS nation, c_mktsegment AS name FROM customer UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier")
def union_distinct(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("name")).union(s.select("s_nationkey", F.lit("SUPPLIER"))).distinct()


@query("""
SELECT 'both' AS kind, * FROM (SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'rest', * FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""")
def multiset_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.intersectAll(s).select(F.lit("both").alias("kind"), "nation").union(c.exceptAll(s).select(F.lit("rest"), "nation"))


@query("""
SELECT bucket, bucket + INTERVAL 2 HOUR AS bucket_end, count(*) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS bucket FROM events) GROUP BY bucket""")
def sliding_windows(spark, sf_dir):
    return (table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("bucket"), F.col("w.end").alias("bucket_end"), "n"))


@query("""
SELECT user_id, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r = 1)""")
def latest_per_key(spark, sf_dir):
    latest = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("x")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(latest).select("user_id", "x.event_id", "x.ts")
