"""Operations on event times: as-of join, sessions, interval overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], bucket=None) -> DataFrame:
    """left with the `values` of the last row of right at or before its `on`, within `by`.

    One union, one shuffle and one sort: no pairs are made. Where right has several
    rows at one time, the one of the largest values counts. Null keys and times
    match nothing: such rows of left get nulls.

    bucket: a function of the column `on` that never decreases with it, such as its
    day. Then rows are shuffled by key and bucket, so that a key with a large part
    of the rows is no single task's, and what a bucket takes over from those before
    it comes from one row of each.
    """
    held = F.lit(True)
    for c in (*by, on):
        held = held & F.col(c).isNotNull()
    found = F.struct(*(F.col(f"asof_{v}").alias(v) for v in values))
    side = F.lit(1).alias("asof_side")
    l = left.select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(f"asof_{v}") for v in values), side)
    kept = {*by, on}
    r = right.where(held).select(*((F.col(c) if c in kept else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns),
                                 *(F.col(v).alias(f"asof_{v}") for v in values), F.lit(0).alias("asof_side"))
    both = l.unionByName(r).withColumn("asof_bucket", F.lit(0) if bucket is None else bucket(F.col(on)))
    order = [on, "asof_side", *(f"asof_{v}" for v in values)]
    w = Window.partitionBy(*by, "asof_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("asof_side") == 0, found), ignorenulls=True).over(w)
    result = both.withColumn("asof_found", F.when(held, last)).where("asof_side = 1")
    if bucket is not None:
        rank = F.struct(*(F.col(c) for c in order))
        ends = both.groupBy(*by, "asof_bucket").agg(F.max_by(F.when(F.col("asof_side") == 0, found), F.when(F.col("asof_side") == 0, rank)).alias("asof_end"))
        before = Window.partitionBy(*by).orderBy("asof_bucket").rowsBetween(Window.unboundedPreceding, -1)
        taken = ends.select(*(F.col(c).alias(f"asof_by_{i}") for i, c in enumerate(by)), F.col("asof_bucket").alias("asof_of"), F.last("asof_end", ignorenulls=True).over(before).alias("asof_taken"))
        same = F.col("asof_bucket") == F.col("asof_of")
        for i, c in enumerate(by):
            same = same & (F.col(c) == F.col(f"asof_by_{i}"))
        result = result.join(taken.where("asof_taken is not null"), same, "left").withColumn("asof_found", F.coalesce("asof_found", "asof_taken"))
    return result.select(*left.columns, *(F.col(f"asof_found.{v}").alias(v) for v in values))


def sessions(events: DataFrame, by: list[str], on: str, gap_seconds: int) -> DataFrame:
    """events with `session`, from 0 in each `by`: a new one after over gap_seconds without an event."""
    w = Window.partitionBy(*by).orderBy(on)
    at = F.unix_micros(F.col(on).cast("timestamp"))
    new = F.when(at - F.lag(at).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    return events.withColumn("session_new", new).withColumn("session", F.sum("session_new").over(w).cast("long")).drop("session_new")


#: Widths double from level to level; what is longer than the last one's is in a single bucket.
_LEVELS = 40


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= at < end, by an equi-join on buckets.

    Buckets are `width` wide for intervals of up to that length, and twice, four
    times ... as wide for longer ones, so each interval is in at most two buckets
    whatever its length, ends at infinity included. A point is in one bucket of
    each width that some interval has. Null ends match nothing.
    """
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    place = lambda x, level: F.when(level > _LEVELS, F.lit(0).cast("long")).otherwise(F.floor(x / size(level)))
    length = (F.col(end) - F.col(start)).cast("double") / F.lit(float(width))
    level = F.when(length <= 1, 0).when(length < 2.0**_LEVELS, F.ceil(F.log2(length))).otherwise(_LEVELS + 1).cast("int")
    spans = intervals.where(F.col(start) < F.col(end)).withColumn("range_level", level)
    first, last = place(F.col(start).cast("double"), F.col("range_level")), place(F.col(end).cast("double"), F.col("range_level"))
    spans = spans.withColumn("range_bucket", F.explode(F.array_distinct(F.array(first, last))))
    levels = sorted(r.range_level for r in spans.select("range_level").distinct().collect())  # of _LEVELS + 2 at most
    p = points.withColumn("range_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    p = p.withColumn("range_bucket", place(F.col(at).cast("double"), F.col("range_level")))
    return p.join(spans, ["range_level", "range_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("range_level", "range_bucket")
