import os
import uuid

import pytest
from pyspark.sql import functions as F

from lodestream.sources import vectorlog


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(vectorlog.VectorLog)
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def frame(spark, ids, parts=1):
    return spark.createDataFrame([(i, [float(i), i / 2]) for i in ids], "id long, vector array<double>").repartition(parts, "id").sortWithinPartitions("id")


def load(spark, folder):
    return spark.read.format("vectorlog").load(folder)


def ids(df):
    return sorted(r.id for r in df.collect())


def save(df, folder, mode="append"):
    df.write.format("vectorlog").mode(mode).save(folder)


def files(folder):
    return sorted(x for x in os.listdir(folder) if x.startswith("rows-"))


def test_rows_come_back(spark, tmp_path):
    d = str(tmp_path / "log")
    save(frame(spark, range(500), 3), d)
    save(spark.createDataFrame([(1000, [1.0]), (1001, [])], "id long, vector array<double>"), d)
    assert {r.id: r.vector for r in load(spark, d).collect()} == {i: [float(i), i / 2] for i in range(500)} | {1000: [1.0], 1001: []}
    save(frame(spark, [7]), d, "overwrite")
    assert ids(load(spark, d)) == [7]
    save(frame(spark, []), d)
    save(frame(spark, [7, 8]), d)
    assert ids(load(spark, d)) == [7, 7, 8]
    assert load(spark, str(tmp_path / "none")).collect() == []


def test_filters_are_pushed_to_files_and_rows(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "log")
    for at in range(0, 100, 10):
        save(frame(spark, range(at, at + 10)), d)
    some = load(spark, d).where("id >= 35 and id < 52 and size(vector) = 2")
    assert ids(some) == list(range(35, 52)) and some.rdd.getNumPartitions() == 3
    assert ids(load(spark, d).where("id = 7")) == [7] and load(spark, d).where("id = 7").rdd.getNumPartitions() == 1
    assert ids(load(spark, d).where("id > 500")) == []
    from pyspark.sql.datasource import EqualTo, IsNotNull, LessThan
    reader = vectorlog.LogReader(d)
    left = list(reader.pushFilters([IsNotNull(("id",)), LessThan(("id",), 15), EqualTo(("vector",), None)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"] and len(reader.partitions()) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    d = str(tmp_path / "log")
    save(frame(spark, range(10)), d)
    before = sorted(os.listdir(d))
    bad = frame(spark, range(100, 200), 4).withColumn("vector", F.when(F.col("id") == 177, F.array(F.lit(1.0), F.lit(None).cast("double"))).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="can't be null"):
        save(bad, d)
    assert sorted(os.listdir(d)) == before and ids(load(spark, d)) == list(range(10))


def test_a_manifest_counts_once(tmp_path):
    d = str(tmp_path)
    part = vectorlog.Part(f"rows-{uuid.uuid4().hex}.npz", 1, 5, 5)
    assert vectorlog.publish(d, [part], False, "s-0") and not vectorlog.publish(d, [part], False, "s-0")
    assert vectorlog.publish(d, [], False) and vectorlog.publish(d, [], False) and len(vectorlog.manifests(d)) == 3
    assert not [x for x in os.listdir(d) if x.startswith(".")]


def test_streams(spark, tmp_path):
    """From one log to another, with a restart between; batches that are there already are left alone."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")

    def run(checkpoint):
        rows = spark.readStream.format("vectorlog").load(a).where("id % 2 = 0")
        q = rows.writeStream.format("vectorlog").option("checkpointLocation", str(tmp_path / checkpoint)).option("stream", "even").trigger(availableNow=True).start(b)
        q.awaitTermination()

    save(frame(spark, range(6)), a)
    save(frame(spark, range(6, 10)), a)
    run("c")
    assert ids(load(spark, b)) == [0, 2, 4, 6, 8]
    save(frame(spark, range(10, 13)), a)
    run("c")
    assert ids(load(spark, b)) == [0, 2, 4, 6, 8, 10, 12]
    there = files(b)
    run("again")  # a lost checkpoint: batches of these numbers are in the log
    assert ids(load(spark, b)) == [0, 2, 4, 6, 8, 10, 12] and files(b) == there
