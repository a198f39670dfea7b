"""Structured Streaming: windowed counts and de-duplication under a watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder; its `ts` as a timestamp, which watermarks ask for."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, every: str, late: str) -> DataFrame:
    """Events by type in windows of `every`; events later than `late` are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("start"), "event_type", "n"))


def sliding_counts(events: DataFrame, size: str, step: str, late: str) -> DataFrame:
    """Events in windows of `size`, a new one every `step`."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("start"), "n"))


def session_counts(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Events of each key in sessions, which end after `gap` without one."""
    return (events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"))


def with_lookup(events: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Events of the stream with the columns of a table; those without a row there get nulls."""
    return events.join(lookup, on, "left")


def followed(first: DataFrame, second: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """(key, first_id, second_id): events of `second` up to `within` after one of `first` with the same key.

    Both have event_id and ts; state is kept for as long as a match can come.
    """
    a = first.select(F.col(key), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = second.select(F.col(key).alias("second_key"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts")).withWatermark("second_ts", late)
    on = F.expr(f"{key} = second_key AND second_ts > first_ts AND second_ts <= first_ts + INTERVAL {within}")
    return a.join(b, on).select(key, "first_id", "second_id")


def first_of_each(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key, remembered as long as `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False) -> None:
    """Process what is there, into Parquet at path, and stop.

    once: in a single batch. State that goes by processing time asks for it: as time goes on by itself, there is always another batch.
    mode update-by-batch: for what only runs in update mode, whose changed rows are added to path batch by batch.
    """
    out = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**({"once": True} if once else {"availableNow": True}))
    if mode == "update-by-batch":
        # a batch that is run again after a failure replaces its own folder
        started = out.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
    else:
        started = out.outputMode(mode).format("parquet").start(path)
    started.awaitTermination()


class RunningTotals(StatefulProcessor):
    """Number and sum of all values of a key so far, a row for each key and batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, value double")

    def handleInputRows(self, key, rows, timerValues):
        n, value = self.total.get() if self.total.exists() else (0, 0.0)
        for part in rows:
            n, value = n + len(part), value + float(part["value"].sum())
        self.total.update((n, value))
        yield pd.DataFrame({"key": [str(key[0])], "n": [n], "value": [value]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, key: str) -> DataFrame:
    """(key, n, value) after each batch, by a state of the caller's own; needs the RocksDB state store."""
    return events.groupBy(key).transformWithStateInPandas(RunningTotals(), "key string, n long, value double", "Update", "None")
