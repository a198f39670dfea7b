"""Queries of sketches, samples and recursion, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import neighbours, recursion, sampling, sketches
from lodestream.plans.registry import query
from lodestream.sources.shared import new_path
from lodestream.sources.tables import table

_LEVELS = ("event_type", "day")


def daily_states(spark, sf_dir, path):
    """events' states by type and day, as a table of days."""
    made = sketches.states(table(spark, sf_dir, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, {"users": F.col("user_id")}, {"spent": F.col("value")})
    sketches.store(made, path, "day")
    return sketches.load(spark, path)


@query("""
SELECT event_type, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close
FROM events GROUP BY ROLLUP (event_type, ts::DATE)""")
def sketch_rollup(spark, sf_dir):
    """Daily states merged by type and over all, held against exact counts and ranks of the same groups."""
    rolled = sketches.merged(daily_states(spark, sf_dir, new_path(spark, "sketches")), list(_LEVELS), ["users"], ["spent"], rollup=True)
    rolled = rolled.select("event_type", "day", "n", sketches.distinct_count("users").alias("estimate"), sketches.quantile("spent", 0.5).alias("median"))
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    users = events.rollup(*_LEVELS).agg(F.count_distinct("user_id").alias("users"))
    every = events.select(F.explode(F.array(F.struct("event_type", "day"), F.struct("event_type", F.lit(None).cast("date").alias("day")),
                                            F.struct(F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("date").alias("day")))).alias("g"), "value")
    every = every.select(F.col("g.event_type").alias("t"), F.col("g.day").alias("d"), "value")
    same = lambda a, b: F.col("event_type").eqNullSafe(F.col(a)) & F.col("day").eqNullSafe(F.col(b))
    ranks = (every.join(rolled, same("t", "d")).groupBy("t", "d")
             .agg((F.count_if(F.col("value") < F.col("median")) / F.count("value")).alias("below"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("up_to")))
    exact = users.withColumnsRenamed({"event_type": "of_type", "day": "of_day"})
    both = rolled.join(exact, same("of_type", "of_day")).join(ranks, same("t", "d"))
    return both.select(
        "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "users",
        (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_BOUND * F.col("users"))).alias("users_close"),
        ((F.col("below") <= 0.5 + sketches.RANK_BOUND) & (F.col("up_to") >= 0.5 - sketches.RANK_BOUND)).alias("median_close"))


_SAMPLE = 40


@query(f"""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY -ln((('0x' || substr(md5('7:' || o_orderkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / o_totalprice, o_orderkey) AS r
  FROM orders WHERE o_totalprice > 0) WHERE r <= {_SAMPLE}""")
def weighted_sample(spark, sf_dir):
    """Orders of each priority, dearer ones likelier: sampled by year and merged."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("y"))
    by_year = sampling.reservoir(orders, _SAMPLE, ["o_orderkey"], ["y", "o_orderpriority"], "o_totalprice")
    return sampling.merge([by_year], _SAMPLE, ["o_orderkey"], ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""
SELECT event_id, user_id FROM events
WHERE (('0x' || substr(md5('7:' || event_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 < 0.1""")
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(table(spark, sf_dir, "events"), 0.1, ["event_id"]).select("event_id", "user_id")


@query("""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
  WHERE a.l_quantity >= 40 AND b.l_quantity >= 40),
r(node, round) AS (SELECT min(l_partkey), 0 FROM lineitem UNION SELECT e.dst, r.round + 1 FROM r JOIN e ON e.src = r.node WHERE r.round < 12)
SELECT node, min(round)::INTEGER AS round FROM r GROUP BY node""")
def recursive(spark, sf_dir):
    """Parts reached from the first one over orders that hold both in large quantities, with the fewest orders on the way (12 at most)."""
    items = table(spark, sf_dir, "lineitem")
    large = items.where("l_quantity >= 40").select("l_orderkey", "l_partkey")
    edges = large.join(large.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")
    return recursion.reachable(edges, items.agg(F.min("l_partkey").alias("node")), rounds=12).select("node", F.col("round").cast("int").alias("round"))


@query("""
WITH RECURSIVE n AS MATERIALIZED (
  SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER w AS before, lag(o_orderdate) OVER w AS before_at FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r(o_orderkey, root, round) AS (
  SELECT o_orderkey, o_orderkey, 0 FROM n WHERE before IS NULL OR o_orderdate > before_at + INTERVAL 90 DAY
  UNION ALL SELECT n.o_orderkey, r.root, r.round + 1 FROM r JOIN n ON n.before = r.o_orderkey AND n.o_orderdate <= n.before_at + INTERVAL 90 DAY)
SELECT o_orderkey, root, round::INTEGER AS round FROM r""")
def order_chains(spark, sf_dir):
    """Chains of a customer's orders with at most 90 days between: the first order of each one's chain, and its place there."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderdate").over(w).alias("before_at"))
    near = F.coalesce(F.col("o_orderdate") <= F.col("before_at") + F.expr("INTERVAL 90 DAY"), F.lit(False))
    start = orders.where(~near).select("o_orderkey", F.col("o_orderkey").alias("root"))
    following = orders.where(near).select(F.col("o_orderkey").alias("next"), "before")
    step = lambda d: d.join(following, d["o_orderkey"] == following["before"]).select(F.col("next").alias("o_orderkey"), "root")
    return recursion.fixpoint(start, step, ["o_orderkey"]).select("o_orderkey", "root", F.col("round").cast("int").alias("round"))


def _inverted_file(spark, sf_dir, k=10, recall=0.9):
    """The embeddings' index, its centroids, queries (ids that 100 divides) and calibrated probes."""
    rows = neighbours.unit(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    queries = rows.where("vec_id % 100 = 0")
    centroids = neighbours.train(rows)
    index = neighbours.build(rows, centroids, new_path(spark, "inverted-file"))
    return index, centroids, queries, neighbours.calibrated(index, centroids, queries, k, recall)


@query()
def nearest_neighbours(spark, sf_dir):
    """Ten near embeddings for each query, and the rows looked at; which ones depends on the cells, so SQL checks the recall instead."""
    index, centroids, queries, probes = _inverted_file(spark, sf_dir)
    found = neighbours.search(index, centroids, queries, 10, probes)
    return found.join(neighbours.scanned(index, centroids, queries, probes), "query_id")


@query("""
WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)
SELECT count(*) AS n_queries, (10 * count(*))::BIGINT AS n_found, true AS recall_reached, true AS scanned_less FROM q""")
def neighbour_recall(spark, sf_dir):
    """Of all queries' true ten nearest, whether nine tenths were found, and whether that took fewer rows than there are."""
    index, centroids, queries, probes = _inverted_file(spark, sf_dir)
    found = neighbours.search(index, centroids, queries, 10, probes).select("query_id", "vec_id", F.lit(1).alias("found"))
    both = neighbours.exact(index, queries, 10).join(found, ["query_id", "vec_id"], "full")
    looked = neighbours.scanned(index, centroids, queries, probes).agg(F.sum("n_scanned").alias("n")).first().n or 0
    every = index.count()
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("found").alias("n_found"),
                    (F.count_if(F.col("found").isNotNull() & F.col("rank").isNotNull()) >= 0.9 * F.count("rank")).alias("recall_reached"),
                    (F.lit(looked) < F.count_distinct("query_id") * F.lit(every)).alias("scanned_less"))
