"""Relational queries over the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(12,2))::DECIMAL(22,2) AS sum_qty,
  sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS sum_price,
  sum((l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,4))::DECIMAL(28,4) AS revenue,
  count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    price, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(22,2)").alias("sum_qty"),
        F.sum(price).cast("decimal(22,2)").alias("sum_price"),
        F.sum((price * (1 - discount)).cast("decimal(18,4)")).cast("decimal(28,4)").alias("revenue"),
        F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_name, count(*) AS n, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
def join_inner(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total")))


@query("""
SELECT c_custkey, count(o_orderkey) AS n_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey""")
def join_left(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.where("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("""
SELECT coalesce(s_suppkey, p_partkey) AS key, s_suppkey, p_partkey, s_acctbal, p_size FROM supplier FULL JOIN part ON s_suppkey = p_partkey""")
def join_full(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return s.join(p, s.s_suppkey == p.p_partkey, "full").select(F.coalesce("s_suppkey", "p_partkey").alias("key"), "s_suppkey", "p_partkey", "s_acctbal", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""
SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g_flag, grouping(l_linestatus)::TINYINT AS g_status, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").alias("g_flag"), F.grouping("l_linestatus").alias("g_status"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderkey) AS last_key
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query("""
SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())""")
def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_shipmonth, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R"
FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY l_shipmonth""")
def pivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return li.groupBy("l_shipmonth").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0, ["A", "N", "R"])


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS prev_price,
  sum(o_totalprice::DECIMAL(12,2)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DECIMAL(22,2) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def windows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.lag("o_totalprice").over(w).alias("prev_price"),
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).over(w.rowsBetween(-2, 0)).cast("decimal(22,2)").alias("moving"))


@query("""
SELECT c_nationkey, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""
(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    both = c.select(F.col("c_nationkey").alias("nation")).intersect(s.select("s_nationkey"))
    return both.union(table(spark, sf_dir, "nation").select("n_nationkey").subtract(c.where("c_acctbal > 9000").select("c_nationkey")))


@query("""
SELECT p_partkey, measure, value FROM (
  SELECT p_partkey, 'size' AS measure, p_size::DOUBLE AS value FROM part UNION ALL
  SELECT p_partkey, 'price', p_retailprice FROM part)""")
def unpivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("""
SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, min(l_shipdate) AS first_ship, max_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS best
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20""".replace("max_by", "arg_max"))
def aggregates(spark, sf_dir):
    return (table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("n_parts"), F.min("l_shipdate").alias("first_ship"),
        F.max_by("l_orderkey", F.col("l_extendedprice") * 1000000 + F.col("l_orderkey")).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 20").drop("n"))
