"""State with timers and expiry, on hand-worked streams."""

import datetime as dt
import time

import pytest

from lodestream.streaming import state, windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


SCHEMA = "event_id long, ts timestamp_ntz, user_id string, event_type string, value double"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # the source takes files by their time


def test_visits_end_by_timers(spark, tmp_path):
    batches = [
        [(1, at(1, 0), "a", "view", 1.0), (2, at(1, 10), "a", "click", 2.0), (3, at(1, 5), "b", "view", 4.0)],
        [(4, at(1, 50), "a", "view", 8.0), (5, at(4, 0), "c", "view", 16.0)],  # a goes on; the watermark comes to 3:50
        [(6, at(2, 0), "b", "view", 99.0), (7, at(4, 30), "c", "click", 32.0), (8, at(4, 5), "a", "error", 64.0)],  # 2:00 is late
        [(9, at(12, 0), "d", "view", 128.0)],
        [(10, at(12, 1), "d", "view", 256.0)],
    ]
    for rows in batches:
        add(spark, f"{tmp_path}/in", rows)
    events = windows.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA))
    windows.run_to_end(state.visits(events, "user_id", "event_type", "value", 3600, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.key, r.first.hour, r.last.hour, r.last.minute, r.n, r["items"], r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("a", 1, 1, 50, 3, "click:1,view:2", 11.0),  # over when the watermark passes 2:50
        ("a", 4, 4, 5, 1, "error:1", 64.0),
        ("b", 1, 1, 5, 1, "view:1", 4.0),  # idle: no event comes after, the late one doesn't count
        ("c", 4, 4, 30, 2, "click:1,view:1", 48.0),
    ]  # d's visit is open


def test_items_come_again_after_expiry(spark, tmp_path):
    def run(rows):
        add(spark, f"{tmp_path}/in", rows)
        events = windows.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA))
        windows.run_to_end(state.fresh(events, "user_id", "event_type", 20), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
        return sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run([(1, at(1), "a", "view", 0.0), (2, at(1), "a", "view", 0.0), (3, at(1), "b", "view", 0.0)]) == [1, 3]
    assert run([(4, at(1), "a", "view", 0.0), (5, at(1), "a", "click", 0.0)]) == [1, 3, 5]
    time.sleep(20)
    assert run([(6, at(1), "a", "view", 0.0)]) == [1, 3, 5, 6]


class Calls:
    """A handle and states that hold nothing, and count what is asked of them."""

    def __init__(self):
        self.n = {}

    def __getattr__(self, name):
        def call(*_):
            self.n[name] = self.n.get(name, 0) + 1
            return False if name == "exists" else self
        return call


def test_visits_that_end_within_a_batch_cost_no_calls():
    import pandas as pd
    visits, calls = state.Visits(3_600_000), Calls()
    visits.init(calls)
    calls.getCurrentWatermarkInMs = lambda: 0
    rows = pd.DataFrame({"ts": [pd.Timestamp(at(h)) for h in range(0, 24, 2)], "item": "view", "value": 1.0})
    tables = list(visits.handleInputRows(("a",), iter([rows]), calls))
    assert [len(t) for t in tables] == [11] and tables[0]["n"].sum() == 11
    assert "clear" not in calls.n and calls.n["registerTimer"] == 1
