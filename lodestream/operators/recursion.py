"""Recursion over tables, semi-naive: each round works on the rows that the round before has added.

Spark's own recursive queries keep no set of what was found, so a graph with
cycles never ends. Here rows are found once by key, rounds stop when one adds
nothing, and every round is written to the shared folder, so lineage stays short
and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.sources.shared import stored

ROUND = "round"


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """All rows that step reaches from start, with the round (from 0) that found each first.

    step: makes candidates, with start's columns, of the rows of the last round
    (which have `round` too). keys: columns that tell rows apart, nulls being equal;
    of a round's rows of one key the least one stays. rounds: stop after so many,
    though there may be more. A cyclic graph ends, as nothing is found twice. The
    driver holds one count a round.
    """
    columns = start.columns
    rest = [c for c in columns if c not in keys]

    def once(df: DataFrame) -> DataFrame:
        least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least")) if rest else df.select(*keys).distinct()
        return least.select(*(F.col(f"least.{c}").alias(c) if c in rest else F.col(c) for c in columns))

    delta = stored(once(start).withColumn(ROUND, F.lit(0)), "round-0")
    found, n = delta, 0
    while not delta.isEmpty() and (rounds is None or n < rounds):
        n += 1
        known = found.select(*(F.col(k).alias(f"known_{k}") for k in keys))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"known_{k}"))
        # what is known grows with the data: merged, never broadcast
        new = once(step(delta).select(*columns)).join(known.hint("merge"), same, "left_anti")
        delta = stored(new.withColumn(ROUND, F.lit(n)), f"round-{n}")
        found = found.unionByName(delta)
    return found


def reachable(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, round): the nodes that edges (src, dst) reach from start (node), with the fewest steps that do."""
    held = edges.select("src", "dst").distinct()
    return fixpoint(start.select("node"), lambda d: d.join(held, d["node"] == held["src"]).select(F.col("dst").alias("node")), ["node"], rounds)
