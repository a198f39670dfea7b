"""Row patterns: regular expressions over the rows of each key in order.

A pattern is built of `row` (one row that fulfils a condition), `seq`, `alt` and
`many` (least to most times, greedy or reluctant), nested at will. Conditions are
columns; Spark evaluates them, and a row carries one bit for each. An automaton
then goes over a key's rows and prefers as Perl's expressions do: the first
alternative, the longest repetition if greedy.

    cheap = many(row("click"), 1)
    match_rows(events, ["user_id"], ["ts"], {"view": F.col("type") == "view", ...}, seq(row("view"), cheap))

The result has the rows of each match with what matched them, so that measures
are plain aggregates over (key, match_first).

Rows are dealt by key, sorted, and read in a stream; a key's rows are held while
they are searched. With `within`, a match spans that many seconds at most, and
rows are dealt by key and stretch of time instead, each stretch with the rows
that its matches can reach beyond it: then a key with a large part of all rows is
many tasks' work, and a task holds one stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Lengths of `within` in a stretch of time: a row is in a second stretch with a chance of one in as many.
STRETCH = 8


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()
    name: str = ""
    least: int = 1
    most: int | None = 1
    greedy: bool = True


def row(name: str) -> Node:
    """One row that fulfils the condition of this name."""
    return Node("row", name=name)


def seq(*parts: Node) -> Node:
    return Node("seq", parts)


def alt(*parts: Node) -> Node:
    """One of the parts; earlier ones are preferred."""
    return Node("alt", parts)


def many(part: Node, least: int = 0, most: int | None = None, greedy: bool = True) -> Node:
    """part, least to most times (None: any number)."""
    return Node("many", (part,), least=least, most=most, greedy=greedy)


def program(pattern: Node, bits: dict[str, int]) -> list[tuple]:
    """Steps: ("row", bit, name), ("fork", preferred, other), ("go", to), ("end",)."""
    steps: list[tuple] = []

    def put(node: Node) -> None:
        if node.kind == "row":
            steps.append(("row", bits[node.name], node.name))
        elif node.kind == "seq":
            for p in node.parts:
                put(p)
        elif node.kind == "alt":
            leaving = []
            for p in node.parts[:-1]:
                at = len(steps)
                steps.append(())
                put(p)
                leaving.append(len(steps))
                steps.append(())
                steps[at] = ("fork", at + 1, len(steps))
            put(node.parts[-1])
            for at in leaving:
                steps[at] = ("go", len(steps))
        else:
            fork = lambda into, past: ("fork", into, past) if node.greedy else ("fork", past, into)
            for _ in range(node.least):
                put(node.parts[0])
            if node.most is None:
                at = len(steps)
                steps.append(())
                put(node.parts[0])
                steps.append(("go", at))
                steps[at] = fork(at + 1, len(steps))
            else:
                skipping = []
                for _ in range(node.most - node.least):
                    skipping.append(len(steps))
                    steps.append(())
                    put(node.parts[0])
                for at in skipping:
                    steps[at] = fork(at + 1, len(steps))
    put(pattern)
    return [*steps, ("end",)]


def match_at(steps: list[tuple], masks: list[int], start: int, stop: int) -> list[str] | None:
    """What each row from start on matched, in the preferred match that ends before stop; None if there is none or only an empty one."""
    found = None

    def follow(to: int, trail, threads: list, seen: set) -> bool:
        """Threads that wait for a row at and behind `to`, the preferred ones first; true when the end is among them."""
        waiting = [to]
        while waiting:
            at = waiting.pop()
            if at in seen:
                continue
            seen.add(at)
            step = steps[at]
            if step[0] == "fork":
                waiting += (step[2], step[1])
            elif step[0] == "go":
                waiting.append(step[1])
            else:
                threads.append((at, trail))
                if step[0] == "end":
                    return True  # what is less preferred can't win any more
        return False

    threads: list = []
    follow(0, None, threads, set())
    for i in range(start, stop):
        new, seen = [], set()
        for at, trail in threads:
            step = steps[at]
            if step[0] == "row" and masks[i] >> step[1] & 1 and follow(at + 1, (trail, step[2]), new, seen):
                found = new[-1][1]
                break
        threads = new
        if not threads:
            break
    if found is None:
        return None
    names = []
    while found is not None:
        found, name = found
        names.append(name)
    return names[::-1]


def beginnings(steps: list[tuple]) -> int:
    """The bits of the conditions that a match can begin with."""
    bits, waiting, seen = 0, [0], set()
    while waiting:
        at = waiting.pop()
        if at not in seen:
            seen.add(at)
            step = steps[at]
            if step[0] == "row":
                bits |= 1 << step[1]
            else:
                waiting += step[1:]
    return bits


def _whole_groups(batches) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by _pm_group; what the last group of a batch has is held back for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("_pm_group").to_numpy()
        if held and held[-1].column("_pm_group")[-1].as_py() != groups[0]:
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(np.diff(groups))
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]) + 1)])
            held = [batch.slice(int(change[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _search(batches, steps, within, past_last, columns, keys):
    first_bits = beginnings(steps)
    for rows in _whole_groups(batches):
        masks, own, times = (rows.column(c).to_numpy() for c in ("_pm_mask", "_pm_own", "_pm_time"))
        new = np.diff(rows.column("_pm_group").to_numpy(), prepend=0) != 0
        for k in keys:  # keys that share a hash
            codes = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero((masks & first_bits != 0) & (own != 0))
        ends = np.append(np.flatnonzero(new), len(masks))
        ends = ends[np.searchsorted(ends, starts, side="right")]
        flags, free = masks.tolist(), 0
        places, firsts, lasts, names = [], [], [], []
        for start, end in zip(starts.tolist(), ends.tolist()):
            if start < free:
                continue
            if within is not None:
                end = start + int(np.searchsorted(times[start:end], times[start] + within, side="right"))
            found = match_at(steps, flags, start, end)
            if found:
                last = start + len(found) - 1
                places += range(start, last + 1)
                firsts += [start] * len(found)
                lasts += [last] * len(found)
                names += found
                free = last + 1 if past_last else 0
        if places:
            kept, order = rows.take(pa.array(places)), rows.column("_pm_order").combine_chunks()
            out = pa.table([*(kept.column(c) for c in columns), order.take(pa.array(firsts)), order.take(pa.array(lasts)), pa.array(names)],
                           names=[*columns, "match_first", "match_last", "match_symbol"])
            yield from out.combine_chunks().to_batches()


def _without_overlap(batches, by: list[str]):
    """Of a key's matches, sorted by their first rows: those that begin after the last row of the one kept before."""
    key, last, first, keep = None, None, None, False
    for batch in batches:
        kept = []
        columns = [batch.column(c).to_pylist() for c in (*by, "match_first", "match_last")]
        for *k, a, b in zip(*columns):
            a, b = tuple(a.values()), tuple(b.values())
            if k != key:
                key, last, first = k, None, None
            if a != first:
                first, keep = a, last is None or a > last
                last = b if keep else last
            kept.append(keep)
        yield batch.filter(pa.array(kept, pa.bool_()))


def match_rows(df: DataFrame, by: list[str], order: list[str], define: dict[str, Column], pattern: Node,
               past_last: bool = True, within: int | None = None) -> DataFrame:
    """The rows of the matches within each `by`, with match_first and match_last (structs of `order`) and match_symbol.

    order: columns that tell a key's rows apart; the first one is a time if within
    (seconds from a match's first row to its last) is given. past_last: a match
    begins after the last row of the one before; else one may begin at any row, and
    rows come out once for each match. Rows with a null in `order` take no part;
    null keys are one key; a condition that is null doesn't hold. With within and
    past_last, a last step reads each key's matches (not its rows) in one task, in
    a stream.
    """
    bits = {name: i for i, name in enumerate(define)}
    steps = program(pattern, bits)
    mask = F.lit(0).cast("long")
    for name, condition in define.items():
        mask = mask.bitwiseOR(F.when(condition, F.lit(1 << bits[name])).otherwise(F.lit(0)).cast("long"))
    known = F.lit(True)
    for c in order:
        known = known & F.col(c).isNotNull()
    time = F.lit(0).cast("long") if within is None else F.unix_micros(F.col(order[0]).cast("timestamp"))
    rows = df.where(known).select(*df.columns, *(F.col(c).alias(f"_pm_by_{i}") for i, c in enumerate(by)),
                                  F.struct(*order).alias("_pm_order"), mask.alias("_pm_mask"), time.alias("_pm_time"))
    dealt = [F.col(f"_pm_by_{i}") for i in range(len(by))]
    if within is None:
        rows = rows.withColumn("_pm_stretch", F.lit(0).cast("long")).withColumn("_pm_own", F.lit(1).cast("tinyint"))
    else:
        micros = within * 1_000_000
        stretch = F.floor(F.col("_pm_time") / F.lit(float(STRETCH * micros))).cast("long")
        reached = F.col("_pm_time") - stretch * (STRETCH * micros) <= micros  # from the stretch before
        of = F.when(reached, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
        rows = rows.select("*", F.posexplode(of).alias("_pm_copy", "_pm_stretch")).withColumn("_pm_own", (F.col("_pm_copy") == 0).cast("tinyint")).drop("_pm_copy")
    rows = rows.withColumn("_pm_group", F.xxhash64(*dealt, "_pm_stretch"))
    dealt = rows.repartition(*dealt, "_pm_stretch").sortWithinPartitions("_pm_group", *dealt, "_pm_stretch", "_pm_order")
    kind = rows.schema["_pm_order"].dataType
    schema = StructType([*df.schema.fields, StructField("match_first", kind), StructField("match_last", kind), StructField("match_symbol", StringType())])
    columns, span, alone = df.columns, None if within is None else within * 1_000_000, past_last and within is None
    keys = [*(f"_pm_by_{i}" for i in range(len(by))), "_pm_stretch"]
    found = dealt.mapInArrow(lambda batches: _search(batches, steps, span, alone, columns, keys), schema)
    if past_last and within is not None:
        found = found.repartition(*by).sortWithinPartitions(*by, "match_first", "match_last").mapInArrow(lambda batches: _without_overlap(batches, by), schema)
    return found
