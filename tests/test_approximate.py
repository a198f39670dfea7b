import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import recursion, sampling, sketches
from lodestream.plans import approximate
from lodestream.sources.tables import table


def test_daily_states_merge_to_one_pass(spark, sf_dir, tmp_path):
    """States of days, stored and rolled up, against one state of all rows and exact values."""
    daily = approximate.daily_states(spark, sf_dir, f"{tmp_path}/states")
    merged = sketches.merged(daily, [], ["users"], ["spent"]).select("n", sketches.distinct_count("users").alias("u"), *(sketches.quantile("spent", q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9)))).first()
    events = table(spark, sf_dir, "events")
    once = sketches.states(events, {}, {"users": F.col("user_id")}, {"spent": F.col("value")}).select("n", sketches.distinct_count("users").alias("u"), sketches.quantile("spent", 0.5).alias("m")).first()
    values, users = sorted(r.value for r in events.collect()), events.select("user_id").distinct().count()
    assert merged.n == once.n == len(values)
    assert abs(merged.u - users) <= sketches.DISTINCT_BOUND * users and abs(merged.u - once.u) <= 2 * sketches.DISTINCT_BOUND * users
    for q, got in zip((0.1, 0.5, 0.9), merged[2:]):
        assert abs(sum(v <= got for v in values) / len(values) - q) <= sketches.RANK_BOUND + 1 / len(values)


def test_errors_are_within_the_bounds(spark):
    """Hundreds of groups of 20,000 distinct users: three standard errors hold for nearly all."""
    df = spark.range(40 * 20_000).select((F.col("id") % 40).alias("g"), F.xxhash64("id").alias("u"), (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("v"))
    got = sketches.states(df, {"g": F.col("g")}, {"s": F.col("u")}, {"q": F.col("v")}).select(sketches.distinct_count("s").alias("n"), sketches.rank("q", F.lit(0.0)).alias("r")).collect()
    errors = [abs(r.n / 20_000 - 1) for r in got]
    assert sum(e <= sketches.DISTINCT_BOUND for e in errors) >= 39 and max(errors) > 0
    assert all(abs(r.r - 0.5) <= sketches.RANK_BOUND for r in got)


def test_states_of_nulls_and_nothing(spark, tmp_path):
    rows = [(1, None, None), (1, None, None), (2, 5, 1.0)]
    made = sketches.states(spark.createDataFrame(rows, "g int, u long, v double"), {"g": F.col("g")}, {"s": F.col("u")}, {"q": F.col("v")})
    got = {r.g: (r.n, r.u) for r in made.select("g", "n", sketches.distinct_count("s").alias("u")).collect()}
    assert got == {1: (2, 0), 2: (1, 1)}
    assert sketches.merged(made.limit(0), ["g"], ["s"], ["q"]).collect() == []


def test_a_day_written_again_is_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2024, 1, d), u) for d in (1, 2) for u in range(d * 3)], "day date, u long")
    for part in (rows, rows.where("day = '2024-01-02'")):
        sketches.store(sketches.states(part, {"day": F.col("day")}, {"s": F.col("u")}, {}), f"{tmp_path}/t", "day")
    assert {str(r.day): r.n for r in sketches.load(spark, f"{tmp_path}/t").collect()} == {"2024-01-01": 3, "2024-01-02": 6}


def orders(spark, n=3000, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice("aaab"), rng.choice([1.0, 9.0])) for i in range(n)], "id long, g string, w double")


def test_samples_do_not_depend_on_partitions(spark):
    df = orders(spark)
    a, b = (sorted(map(tuple, sampling.reservoir(df.repartition(n), 30, ["id"], ["g"], "w").collect())) for n in (1, 8))
    assert a == b and len(a) == 60


def test_merged_samples_are_the_sample_of_the_union(spark):
    df = orders(spark)
    parts = [sampling.reservoir(df.where(F.col("id") % 3 == k), 30, ["id"], ["g"], "w") for k in range(3)]
    whole = sampling.reservoir(df, 30, ["id"], ["g"], "w")
    assert sorted(map(tuple, sampling.merge(parts, 30, ["id"], ["g"]).collect())) == sorted(map(tuple, whole.collect()))


def test_heavier_rows_are_likelier(spark):
    """First draws are proportional to weights: half the rows weigh nine times as much as the others."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("w"), (F.col("id") / 2 % 250).cast("int").alias("g"))
    got = sampling.reservoir(df, 1, ["id"], ["g"], "w").collect()
    heavy = sum(r.w == 9.0 for r in got)
    assert len(got) == 250 and abs(heavy / 250 - 0.9) < 4 * math.sqrt(0.09 / 250)


def test_rows_without_a_weight(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0), (4, float("nan")), (5, 2.0), (None, 1.0)], "id long, w double")
    assert sorted((r.id is None, r.id) for r in sampling.reservoir(df, 9, ["id"], weight="w").collect()) == [(False, 5), (True, None)]
    assert sampling.reservoir(df.limit(0), 9, ["id"]).collect() == []


def test_tasks_keep_the_smallest_keys_before_the_shuffle(spark, sf_dir):
    plan = sampling.reservoir(table(spark, sf_dir, "orders"), 5, ["o_orderkey"], ["o_orderpriority"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the exchange and behind it


def test_shares_are_nested(spark):
    ids = lambda share: {r.id for r in sampling.bernoulli(spark.range(5000), share, ["id"]).collect()}
    assert ids(0.1) < ids(0.3) and abs(len(ids(0.3)) / 5000 - 0.3) < 0.03


def brute_reach(edges, start, rounds=None):
    found, at = {n: 0 for n in start}, set(start)
    n = 0
    while at and (rounds is None or n < rounds):
        n += 1
        at = {b for a, b in edges if a in at and b not in found}
        found |= {x: n for x in at}
    return found


@pytest.mark.parametrize("rounds", [None, 2, 0])
def test_reach_of_a_graph_with_cycles(spark, rounds):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(5, 5), (0, 1), (1, 0), (None, 2), (2, None)]
    got = recursion.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (0,), (7,)], "node long"), rounds)
    want = brute_reach([(a, b) for a, b in edges if a is not None], [0, 7], rounds)
    assert {r.node: r.round for r in got.collect()} == want and got.count() == len(want)


def test_nothing_to_start_from(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert recursion.reachable(edges, edges.select(F.col("src").alias("node")).limit(0)).collect() == []


def test_rows_of_one_key_found_together(spark):
    """Of several paths that find a node in one round, the least row stays."""
    edges = spark.createDataFrame([(0, 1, 9), (0, 2, 1), (1, 3, 1), (2, 3, 5)], "src long, dst long, cost long")
    start = spark.createDataFrame([(0, 0)], "node long, cost long")
    step = lambda d: d.join(edges.withColumnRenamed("cost", "more"), d["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("more")).alias("cost"))
    got = {r.node: (r.cost, r.round) for r in recursion.fixpoint(start, step, ["node"]).collect()}
    assert got == {0: (0, 0), 1: (9, 1), 2: (1, 1), 3: (6, 2)}
