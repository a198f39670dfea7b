"""Operations on groups and batches in pandas or Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a call of a function gets, about: many keys' at once, as a call costs a millisecond whatever its rows.
CALL_ROWS = 50_000


def _bucket(by: str, buckets: int):
    """Whole keys, nulls together."""
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def smoothed(df: DataFrame, by: str, order: list[str], column: str, out: str, share: float) -> DataFrame:
    """df with out: the exponentially smoothed column within `by`, share of each new value and the rest of what was before; null keys are one key.

    Each value depends on the one before, so a key's rows meet in one call; calls
    get whole keys, about CALL_ROWS rows in all.
    """
    def of_keys(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        found = rows.groupby(by, dropna=False)[column].ewm(alpha=share, adjust=False).mean().droplevel(0)
        return rows.drop(columns="bucket").assign(**{out: found})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("bucket", _bucket(by, -(-df.count() // CALL_ROWS) or 1)).groupBy("bucket").applyInPandas(of_keys, f"{fields}, `{out}` double")


def nearest(left: DataFrame, right: DataFrame, on: str, by: str, value: str, within: pd.Timedelta) -> DataFrame:
    """(by, on, value): left's rows with the value of the right row nearest in time, before or after, within the distance; before if both are as near.

    Cogrouped pandas: calls get whole keys of both sides. Rows of left with a null
    key or time get null; of right rows at one time the one of the largest value counts.
    """
    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[by, on, value])
        held = a[by].notna() & a[on].notna()
        if not len(b):  # an absent group has no columns either
            return a.assign(**{value: None})[[by, on, value]]
        b = b.dropna(subset=["right_by", "right_on"]).sort_values(["right_on", "right_value"], kind="stable").drop_duplicates(["right_by", "right_on"], keep="last")
        b = b[["right_by", "right_on", "right_value"]].set_axis([by, on, value], axis=1)
        found = pd.merge_asof(a[held].sort_values(on, kind="stable"), b.astype({by: a[held][by].dtype}), on=on, by=by, direction="nearest", tolerance=within)
        return pd.concat([found[[by, on, value]], a[~held].assign(**{value: None})[[by, on, value]]]) if not held.all() else found[[by, on, value]]

    schema = f"{by} {left.schema[by].dataType.simpleString()}, {on} {left.schema[on].dataType.simpleString()}, {value} {right.schema[value].dataType.simpleString()}"
    buckets = -(-(left.count() + right.count()) // CALL_ROWS) or 1
    # names of its own, as both may come from one table
    r = right.select(F.col(by).alias("right_by"), F.col(on).alias("right_on"), F.col(value).alias("right_value"), _bucket(by, buckets).alias("right_bucket"))
    mine = left.select(by, on, _bucket(by, buckets).alias("bucket"))
    return mine.groupBy("bucket").cogroup(r.groupBy("right_bucket")).applyInPandas(join, schema)


def without_outliers(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose column is within the bounds, batch by batch in Arrow; nulls go."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(column)
            yield b.filter(pc.and_(pc.greater_equal(x, low), pc.less_equal(x, high)))
    return df.mapInArrow(keep, df.schema)
