import random
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestream.functions import udtfs
from lodestream.operators.frames import groups_frame
from lodestream.plans import extended
from lodestream.sources import bucketed

AGGREGATES = {"total": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "top": ("max", "v")}


def brute(rows, start, end, without_peers):
    """(id, total, n, low, top) by looking at each row's frame: k, o (ascending, nulls first), v by id."""
    keys = defaultdict(set)
    rank = lambda o: (o is not None, o or 0)
    for _, k, o, _ in rows:
        keys[k].add(o)
    place = {(k, o): i for k, os in keys.items() for i, o in enumerate(sorted(os, key=rank))}
    out = []
    for i, k, o, _ in rows:
        steps = lambda q: place[k, q] - place[k, o]
        frame = [v for _, j, q, v in rows if j == k and (start is None or steps(q) >= start) and (end is None or steps(q) <= end)
                 and not (without_peers and q == o) and v is not None]
        out.append((i, sum(frame) if frame else None, len(frame), min(frame, default=None), max(frame, default=None)))
    return sorted(out)


@pytest.mark.parametrize("start, end", [(-1, 1), (None, 0), (0, None), (-3, -2), (1, 2), (0, 0), (None, None)])
@pytest.mark.parametrize("without_peers", [False, True])
def test_group_frames(spark, start, end, without_peers):
    rng = random.Random(0)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, 2, 3, 5, 8, None]), rng.choice([1, 2, 3, None])) for i in range(60)] + [(99, "lone", 1, 4)]
    got = groups_frame(spark.createDataFrame(rows, "id long, k string, o long, v long"), ["k"], {"o": True}, AGGREGATES, start, end, without_peers)
    assert sorted((r.id, r.total, r.n, r.low, r.top) for r in got.collect()) == brute(rows, start, end, without_peers)


def test_group_frames_downwards_and_of_several_columns(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), rng.randrange(3), rng.randrange(9)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a long, b long, v long")
    got = groups_frame(df, [], {"a": False, "b": True}, AGGREGATES, -1, 2)
    flat = [(i, "", (3 - a) * 10 + b, v) for i, a, b, v in rows]
    assert sorted((r.id, r.total, r.n, r.low, r.top) for r in got.collect()) == brute(flat, -1, 2, False)
    assert groups_frame(df.limit(0), ["a"], {"b": True}, AGGREGATES, -1, 1).collect() == []


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = extended.bucketed_join(spark, sf_dir)
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_write_has_a_file_a_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50 if i % 3 else None, i) for i in range(1000)], "k long, v long")
    name = bucketed.write_bucketed(rows, ["k"], 5, path=f"{tmp_path}/t")
    assert len(list(tmp_path.glob("t/part-*"))) == 5
    assert spark.table(name).exceptAll(rows).count() == 0 == rows.exceptAll(spark.table(name)).count()
    empty = bucketed.write_bucketed(rows.limit(0), ["k"], 5, path=f"{tmp_path}/e")
    assert spark.table(empty).count() == 0
    assert spark.table(bucketed.write_bucketed(rows.limit(3), ["k"], 5, name, f"{tmp_path}/t")).count() == 3


def packed(rows, limit):
    out, at = [], {}
    for k, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        batch, filled = at.get(k, (0, None))
        if v is not None:
            batch, filled = (batch + 1, v) if filled is not None and filled + v > limit else (batch, (filled or 0) + v)
        at[k] = batch, filled
        out.append((k, o, v, batch, filled))
    return sorted(out, key=str)


def test_table_function(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([1, 5, 20, None])) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    got = udtfs.packed(df, ["k"], ["o"], "v", 12)
    assert got.columns == ["k", "o", "v", "batch", "filled"] and dict(got.dtypes)["filled"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=str) == packed(rows, 12)
    assert udtfs.packed(df.limit(0), ["k"], ["o"], "v", 12).collect() == []
    assert dict(udtfs.packed(df.withColumn("v", F.col("v").cast("double")), ["k"], ["o"], "v", 1.5).dtypes)["filled"] == "double"


@pytest.mark.parametrize("measure, limit, said", [("nothing", 5, "name a column"), ("v", 0, "over 0")])
def test_table_function_refuses_wrong_arguments(spark, measure, limit, said):
    with pytest.raises(AnalysisException, match=said):
        udtfs.packed(spark.createDataFrame([("a", 1, 1)], "k string, o long, v long"), ["k"], ["o"], measure, limit).collect()
