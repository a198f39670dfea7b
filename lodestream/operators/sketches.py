"""Mergeable sketches: states of distinct counts and quantiles, kept by day and merged later.

A state is a few KB for a group whatever its rows: HyperLogLog registers for
distinct counts, KLL compactors for quantiles. `states` makes them in one pass
with partial aggregation, `store` adds them to a table partitioned by day, and
`merged` rolls them up to coarser groups without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registers are 2 ** HLL_BITS: the relative standard error of a distinct count is about 1.04 / 2 ** (HLL_BITS / 2).
HLL_BITS = 12
#: A KLL state of this parameter has a rank error of about 1.65 % for a single quantile, at 99 % confidence.
KLL_K = 200
#: Three standard errors of the one, twice the other's error.
DISTINCT_BOUND, RANK_BOUND = 3 * 1.04 / 2 ** (HLL_BITS / 2), 2 * 0.0165


def states(df: DataFrame, by: dict[str, Column], distinct: dict[str, Column], quantiles: dict[str, Column]) -> DataFrame:
    """A row for each group of `by`: n, and a state of each name. Nulls are left out of states; a group of nulls alone has an empty or null one."""
    return df.groupBy(*(c.alias(name) for name, c in by.items())).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.hll_sketch_agg(c, HLL_BITS).alias(name) for name, c in distinct.items()),
        *(F.kll_sketch_agg_double(c.cast("double"), KLL_K).alias(name) for name, c in quantiles.items()))


def store(df: DataFrame, path: str, day: str) -> None:
    """Add states to a table of a folder for each day. A day that is written again is replaced, so a rerun counts nothing twice."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(df: DataFrame, by: list[str], distinct: list[str], quantiles: list[str], rollup: bool = False) -> DataFrame:
    """States of df merged to the groups of `by`; rollup: and to those of its prefixes, down to all rows, with a column `level` of grouped columns."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    level = [(F.lit(len(by)) - sum((F.grouping(c) for c in by), F.lit(0))).cast("int").alias("level")] if rollup else []
    return grouped.agg(*level, F.sum("n").alias("n"), *(F.hll_union_agg(c).alias(c) for c in distinct), *(F.kll_merge_agg_double(c).alias(c) for c in quantiles))


def distinct_count(state: str | Column) -> Column:
    return F.hll_sketch_estimate(state)


def quantile(state: str | Column, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(rank))


def rank(state: str | Column, value: Column) -> Column:
    """The estimated share of values up to this one."""
    return F.kll_sketch_get_rank_double(state, value)
