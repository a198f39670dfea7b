"""Window frames over groups of peers, which Spark's windows lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How an aggregate is made of rows, and how those of several groups of peers are put together.
_KINDS = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def groups_frame(df: DataFrame, by: list[str], order: dict[str, bool], aggregates: dict[str, tuple[str, str | Column]],
                 start: int | None, end: int | None, without_peers: bool = False) -> DataFrame:
    """df with aggregates over GROUPS BETWEEN start AND end: rows that are equal in `order` are peers and count as one step.

    order: columns, true if ascending (nulls first; descending: last). aggregates:
    name to (sum, count, min or max; column). start, end: groups relative to the
    current one, None for all on that side. without_peers: EXCLUDE GROUP. Each
    group of peers is aggregated to one row first, so the window runs over peers and
    not rows: a key with a large part of the rows costs as many rows as it has
    distinct values. Nulls in by and order are equal to each other.
    """
    keys = [*by, *order]
    peers = df.groupBy(*(F.col(c).alias(f"peer_{i}") for i, c in enumerate(keys))).agg(*(_KINDS[kind][0](c).alias(f"made_{name}") for name, (kind, c) in aggregates.items()))
    places = dict(zip(order, range(len(by), len(keys))))
    w = Window.partitionBy(*(f"peer_{i}" for i in range(len(by)))).orderBy(*(F.col(f"peer_{i}").asc() if order[c] else F.col(f"peer_{i}").desc() for c, i in places.items()))
    first, last = Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end
    frames = [(first, -1), (1, last)] if without_peers and first <= 0 <= last else [(first, last)]
    frames = [w.rowsBetween(a, b) for a, b in frames if a <= b]

    def over(name: str, kind: str) -> Column:
        parts = [_KINDS[kind][1](f"made_{name}").over(f) for f in frames]
        if kind in ("min", "max"):
            found = F.array_compact(F.array(*parts)) if parts else F.array()
            return F.array_min(found) if kind == "min" else F.array_max(found)
        held = F.lit(False)
        for p in parts:
            held = held | p.isNotNull()
        total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
        return total.cast("long") if kind == "count" else F.when(held, total)

    framed = peers.select(*(f"peer_{i}" for i in range(len(keys))), *(over(name, kind).alias(name) for name, (kind, _) in aggregates.items()))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & df[c].eqNullSafe(framed[f"peer_{i}"])
    return df.join(framed, same).select(*(df[c] for c in df.columns), *aggregates)
