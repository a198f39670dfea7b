"""Keyed state with timers and expiry; both need the RocksDB state store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class Visits(StatefulProcessor):
    """A row for each visit: a key's events with no gap of over `gap_ms` between, once the visit is over.

    It is over when an event comes after the gap, or when the watermark passes the
    end of the gap: then an event-time timer fires, whether the key has any more
    events or not. State of a key: first and last time, its distinct items with
    their counts (a map), and the values in order of arrival (a list), until the
    visit is over.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first long, last long, n long")
        self.items = handle.getMapState("items", "item string", "n long")
        self.values = handle.getListState("values", "value double")

    def _held(self) -> tuple[list, dict, list] | None:
        """What a key's open visit has: (first, last, n), items and values."""
        if not self.span.exists():
            return None
        return list(self.span.get()), {k[0]: v[0] for k, v in self.items.iterator()}, [v[0] for v in self.values.get()]

    def _hold(self, visit, known: int) -> None:
        """Keep an open visit; known: how many of its values the state has already."""
        span, items, values = visit
        self.span.update(tuple(span))
        for k, n in items.items():
            self.items.updateValue((k,), (n,))
        if known:
            for v in values[known:]:
                self.values.appendValue((v,))
        else:
            self.values.put([(v,) for v in values])

    def _drop(self) -> None:
        for state in (self.span, self.items, self.values):
            state.clear()

    @staticmethod
    def _rows(key, visits: list) -> pd.DataFrame:
        """A row for each visit, in one table: to make one costs more than its rows."""
        found = [(str(key[0]), first, last, n, ",".join(f"{k}:{c}" for k, c in sorted(items.items())), float(sum(values))) for (first, last, n), items, values in visits]
        return pd.DataFrame(found, columns=["key", "first_ms", "last_ms", "n", "items", "total"])

    def handleInputRows(self, key, rows, timerValues):
        """The state is read and written once a batch, however many rows there are."""
        watermark = timerValues.getCurrentWatermarkInMs()
        events = pd.concat(list(rows)).sort_values("ts", kind="stable")
        visit = self._held()
        timer, known, over = visit and visit[0][1] + self.gap, len(visit[2]) if visit else 0, []
        for ts, item, value in zip(events["ts"], events["item"], events["value"]):
            at = _millis(ts)
            if at < watermark:  # Spark drops what is behind the watermark of the batch before
                continue
            if visit and at - visit[0][1] > self.gap:
                over.append(visit)
                if known:  # later visits of the batch have no state yet
                    self._drop()
                visit, known = None, 0
            if visit is None:
                visit = ([at, at, 0], {}, [])
            span, items, values = visit
            span[:] = min(span[0], at), max(span[1], at), span[2] + 1
            items[item] = items.get(item, 0) + 1
            values.append(value)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if visit:
            self._hold(visit, known)
            self.handle.registerTimer(visit[0][1] + self.gap)
        if over:
            yield self._rows(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        visit = self._held()
        if visit and visit[0][1] + self.gap <= expiredTimerInfo.getExpiryTimeInMs():
            self._drop()
            yield self._rows(key, [visit])

    def close(self) -> None:
        pass


def visits(events: DataFrame, key: str, item: str, value: str, gap_seconds: int, late: str) -> DataFrame:
    """(key, first, last, n, items, total) of each visit that is over; events later than `late` are dropped. items: "item:count", sorted."""
    rows = events.withWatermark("ts", late).select(key, "ts", F.col(item).alias("item"), F.col(value).cast("double").alias("value"))
    found = rows.groupBy(key).transformWithStateInPandas(Visits(gap_seconds * 1000), "key string, first_ms long, last_ms long, n long, items string, total double", "Append", "EventTime")
    return found.select("key", F.timestamp_millis("first_ms").alias("first"), F.timestamp_millis("last_ms").alias("last"), "n", "items", "total")


class Fresh(StatefulProcessor):
    """Rows whose item the key hasn't had for ttl_ms of processing time; what is older is dropped by the state store."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "item string", "n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            keep = []
            for item in part["item"]:
                new = not self.seen.containsKey((item,))
                if new:
                    self.seen.updateValue((item,), (1,))
                keep.append(new)
            yield pd.DataFrame({"key": part["key"][keep].astype(str), "item": part["item"][keep], "event_id": part["event_id"][keep]})

    def close(self) -> None:
        pass


def fresh(events: DataFrame, key: str, item: str, ttl_seconds: float) -> DataFrame:
    """(key, item, event_id): the first event of each item of a key, and again one after the item's state has expired."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(item).alias("item"), "event_id")
    return rows.groupBy("key").transformWithStateInPandas(Fresh(int(ttl_seconds * 1000)), "key string, item string, event_id long", "Append", "ProcessingTime")
