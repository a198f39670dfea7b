"""Weighted sampling without replacement, stratified, by keys that a seed and a row's id give.

A row's key is -ln(u) / weight, u a uniform number from an MD5 of seed and id;
the rows of the `size` smallest keys of a stratum are its sample. The same seed
and ids give the same sample on any cluster and any partitioning. A sample keeps
its keys, so that it is a state too: the sample of a union is the sample of the
union of samples. Spark takes the smallest keys of each task before it shuffles,
so a stratum with most of the rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "sample_key"


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5 of the seed and the parts as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _smallest(keyed: DataFrame, size: int, by: list[str], ids: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(KEY, *ids))
    return keyed.withColumn("sample_place", place).where(F.col("sample_place") <= size).drop("sample_place")


def reservoir(df: DataFrame, size: int, ids: list[str], by: list[str] = (), weight: str | Column | None = None, seed: int = 7) -> DataFrame:
    """df's rows in the sample of each stratum of `by`, with sample_key. Rows whose weight is null, NaN or not over 0 take no part.

    ids: columns that tell rows apart; equal rows get equal keys.
    """
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    keyed = df.where((w > 0) & ~F.isnan(w)).withColumn(KEY, -F.ln(uniform(seed, *(F.col(c) for c in ids))) / w)
    return _smallest(keyed, size, list(by), ids)


def merge(samples: list[DataFrame], size: int, ids: list[str], by: list[str] = ()) -> DataFrame:
    """The sample of the rows that several samples, of one seed and at least this size, were taken of; these must not share rows."""
    union = samples[0]
    for s in samples[1:]:
        union = union.unionByName(s)
    return _smallest(union, size, list(by), ids)


def bernoulli(df: DataFrame, share: float, ids: list[str], seed: int = 7) -> DataFrame:
    """Each row with a chance of `share`, by its ids: a row is in a larger share's sample too."""
    return df.where(uniform(seed, *(F.col(c) for c in ids)) < share)
