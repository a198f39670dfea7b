import datetime as dt
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text, udfs
from lodestream.operators import grouped, temporal
from lodestream.sources import files, vectors
from lodestream.sources.tables import table
from lodestream.streaming import windows


@pytest.mark.parametrize("kind", sorted(files.FORMATS))
def test_round_trip(spark, sf_dir, tmp_path, kind):
    df = table(spark, sf_dir, "orders")
    files.write(df, f"{tmp_path}/x", kind)
    back = files.read(spark, f"{tmp_path}/x", kind, df.schema)
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0


def test_partitioned_write_prunes(spark, sf_dir, tmp_path):
    df = table(spark, sf_dir, "orders")
    files.write(df, f"{tmp_path}/x", "parquet", by=["o_orderstatus"])
    some = files.read(spark, f"{tmp_path}/x", "parquet").where("o_orderstatus = 'F'")
    assert some.count() == df.where("o_orderstatus = 'F'").count()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in some._jdf.queryExecution().toString()


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k long, t long, x string")
    right = spark.createDataFrame([(1, 5, 7), (1, 5, 8), (1, 3, None), (3, 1, 1)], "k long, t long, v long")
    got = {r.x: r.v for r in temporal.asof_join(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {"a": 8, "b": None, "c": None}


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 4)])
def test_asof_null_keys_and_buckets(spark, bucket):
    left = spark.createDataFrame([(None, 5, "a"), (1, None, "b"), (1, 1, "c"), (1, 30, "d"), (2, 30, "e"), (1, 12, "f")], "k long, t long, x string")
    right = spark.createDataFrame([(None, 5, 7), (1, None, 9), (1, 2, 3), (1, 13, None), (2, 1, 5), (2, 29, 6)], "k long, t long, v long")
    got = {r.x: r.v for r in temporal.asof_join(left, right, "t", ["k"], ["v"], bucket).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": None, "e": 6, "f": 3}


def test_asof_buckets_change_nothing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("v"))
    plain, dealt = (temporal.asof_join(e, views, "ts", ["user_id"], ["v"], b) for b in (None, lambda t: F.date_trunc("hour", t)))
    assert plain.exceptAll(dealt).count() == dealt.exceptAll(plain).count() == 0


def test_range_join_of_endless_intervals(spark):
    inf = float("inf")
    points = spark.createDataFrame([(x,) for x in (-1e30, -5.0, 0.0, 3.0, 999.0, 1e15, 1e300, float("nan"), None)], "at double")
    spans = spark.createDataFrame([(-inf, inf), (0.0, inf), (-inf, 1.0), (2.5, 3.5), (1e14, 1e16), (0.0, 1e9), (5.0, 5.0), (None, 3.0)], "lo double, hi double")
    got = temporal.range_join(points, spans, "at", "lo", "hi", 1.0)
    want = points.crossJoin(spans).where("at >= lo and at < hi")
    assert want.count() > 10 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert temporal.range_join(points, spans.limit(0), "at", "lo", "hi", 1.0).count() == 0


def test_text_binary_and_image_files(spark, tmp_path):
    df = spark.createDataFrame([("one",), ("two é",), ("",)], "value string")
    files.write_lines(df, f"{tmp_path}/t")
    assert sorted(r.value for r in files.lines(spark, f"{tmp_path}/t").collect()) == ["", "one", "two é"]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([10 * y + x for x in range(6)]) for y in range(3))  # 2 by 3, red, green and blue
    pixel = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.png").write_bytes(pixel)
    (tmp_path / "b/y.txt").write_bytes(b"no image")
    assert [bytes(r.content) for r in files.whole_files(spark, f"{tmp_path}/b", "*.png").collect()] == [pixel]
    assert [(r.height, r.width, r.nChannels, bytes(r.data)[:6]) for r in files.images(spark, f"{tmp_path}/b").collect()] == [(3, 2, 3, bytes([2, 1, 0, 5, 4, 3]))]


def test_npy_source(spark, tmp_path):
    rng = np.random.default_rng(0)
    parts = {"a.npy": rng.normal(size=(5000, 3)), "b.npy": rng.normal(size=(2, 3)), "c.npy": np.zeros((0, 3))}
    for name, x in parts.items():
        np.save(tmp_path / name, x)
    spark.dataSource.register(vectors.NpySource)
    got = {(r.file, r.row): r.vector for r in spark.read.format("npy").load(str(tmp_path)).collect()}
    assert got == {(name, i): x.tolist() for name, m in parts.items() for i, x in enumerate(m)}


def test_range_join_has_each_pair_once(spark):
    points = spark.range(100).select(F.col("id").cast("double").alias("at"))
    spans = spark.createDataFrame([(float(a), float(a + n)) for a in range(0, 90, 7) for n in (0, 1, 13, 60)], "lo double, hi double")
    got = temporal.range_join(points, spans, "at", "lo", "hi", 10.0)
    want = points.crossJoin(spans).where("at >= lo and at < hi")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([(" a  b\tc\n", "http://h.x:80/p", [1.0, 2.0]), (None, "", [0.0, 1.0])], "t string, u string, v array<double>")
    got = df.select(text.word_count("t"), text.url_host("u"), text.dot("v", "v")).collect()
    assert [tuple(r) for r in got] == [(3, "h.x", 5.0), (0, "", 1.0)]


@pytest.fixture
def stream(spark, tmp_path):
    """A function that makes a stream of batches of (event_id, hour, minute, user_id, value)."""
    def make(name, *batches):
        schema = "event_id long, ts timestamp_ntz, user_id string, value double"
        for i, rows in enumerate(batches):
            made = [(e, dt.datetime(2024, 1, 1, h, m), u, v) for e, h, m, u, v in rows]
            spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            time.sleep(1.1)  # the source takes files by their time
        return windows.read_events(spark, f"{tmp_path}/{name}", spark.createDataFrame([], schema))

    def result(df, name, mode="append"):
        windows.run_to_end(df, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-state", mode)
        return spark.read.parquet(f"{tmp_path}/{name}-out").drop("batch").collect()

    return make, result


def test_sliding_and_session_windows(stream):
    make, result = stream
    events = make("in", [(1, 1, 0, "a", 1.0), (2, 1, 20, "a", 1.0), (3, 2, 10, "b", 1.0)], [(4, 9, 0, "b", 1.0)], [(5, 20, 0, "b", 1.0)])
    got = {(r.start.hour, r.n) for r in result(windows.sliding_counts(events, "2 hours", "1 hour", "1 hour"), "sliding")}
    assert got == {(0, 2), (1, 3), (2, 1), (8, 1), (9, 1)}
    got = {(r.user_id, r.start.hour, r.end.hour, r.n) for r in result(windows.session_counts(events, "user_id", "30 minutes", "1 hour"), "sessions")}
    assert got == {("a", 1, 1, 2), ("b", 2, 2, 1), ("b", 9, 9, 1)}


def test_stream_joins(spark, stream):
    make, result = stream
    first, second = make("in1", [(1, 1, 0, "a", 0.0), (2, 1, 0, "b", 0.0)], [(3, 5, 0, "a", 0.0)]), make("in2", [(11, 1, 30, "a", 0.0), (12, 3, 0, "b", 0.0)], [(13, 5, 59, "a", 0.0), (14, 9, 0, "a", 0.0)])
    got = {tuple(r) for r in result(windows.followed(first, second, "user_id", "1 HOUR", "1 hour"), "pairs")}
    assert got == {("a", 1, 11), ("a", 3, 13)}
    names = spark.createDataFrame([("a", "Ann")], "user_id string, name string")
    assert {(r.event_id, r.name) for r in result(windows.with_lookup(first, names, "user_id"), "named")} == {(1, "Ann"), (2, None), (3, "Ann")}


def test_state_of_ones_own(spark, stream):
    make, result = stream
    events = make("in", [(1, 1, 0, "a", 1.0), (2, 1, 0, "b", 5.0), (3, 1, 0, "a", 2.0)], [(4, 2, 0, "a", 4.0)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = {tuple(r) for r in result(windows.running_totals(events, "user_id"), "totals", "update-by-batch")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {("a", 2, 3.0), ("b", 1, 5.0), ("a", 3, 7.0)}


def test_stream_drops_late_events(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1), "view")], [(2, at(5), "view"), (2, at(5), "view")], [(6, at(5, 30), "view")], [(3, at(1, 30), "view"), (4, at(9), "click")], [(5, at(20), "view")]]
    like = spark.createDataFrame(batches[0], "event_id long, ts timestamp_ntz, event_type string")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, like.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # the source takes files by their time
    events = windows.read_events(spark, f"{tmp_path}/in", like)
    windows.run_to_end(windows.windowed_counts(events, "1 hour", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c1")
    got = {(r.start.hour, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "view"): 1, (5, "view"): 3, (9, "click"): 1}  # 1:30 came two batches after 5:00; hour 20 is open
    windows.run_to_end(windows.first_of_each(events, ["event_id"], "1 hour"), f"{tmp_path}/out2", f"{tmp_path}/c2")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == [1, 2, 4, 5, 6]


def test_smoothing_of_whole_keys(spark, monkeypatch):
    monkeypatch.setattr(grouped, "CALL_ROWS", 7)
    rows = [(k, t, float((t * 7 + (k or 0) * 3) % 11)) for k in (1, 2, 3, None) for t in range(9)]
    got = {(r.k, r.t): r.s for r in grouped.smoothed(spark.createDataFrame(rows, "k long, t long, x double").repartition(5), "k", ["t"], "x", "s", 0.25).collect()}
    want, last = {}, {}
    for k, t, x in rows:
        last[k] = want[k, t] = x if k not in last else 0.25 * x + 0.75 * last[k]
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_nearest_on_either_side(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 1, m)
    left = spark.createDataFrame([(1, at(10)), (1, at(50)), (2, at(10)), (None, at(10)), (1, None), (3, at(10))], "k long, ts timestamp_ntz")
    right = spark.createDataFrame([(1, at(8), 1.0), (1, at(12), 2.0), (1, at(12), 3.0), (1, at(30), 4.0), (2, at(11), 5.0), (None, at(10), 6.0)], "k long, ts timestamp_ntz, v double")
    got = sorted((r.k or 0, r.ts.minute if r.ts else 0, r.v) for r in grouped.nearest(left, right, "ts", "k", "v", pd.Timedelta(minutes=15)).collect())
    assert got == [(0, 10, None), (1, 0, None), (1, 10, 1.0), (1, 50, None), (2, 10, 5.0), (3, 10, None)]


def test_plain_letters():
    assert [udfs.plain(t) for t in (None, "", "abc", "é́ñ ﬁ 中 ß", "Å")] == [None, "", "abc", "en ﬁ 中 ß", "A"]


def test_texts_come_in_bounded_batches(spark, sf_dir):
    """Python workers get few whole texts at once, whatever the session's setting, and no more than a smaller one."""
    from lodestream.functions import udfs
    from lodestream.plans import udfs as queries
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows, most in (("10000", udfs.BATCH_ROWS), ("0", udfs.BATCH_ROWS), ("100", 100)):
            spark.conf.set(key, rows)
            for query in (queries.udf_by_arrow, queries.arrow_udf):
                assert query(spark, sf_dir).count() == 200 and int(spark.conf.get(key)) == most
    finally:
        spark.conf.set(key, before)
