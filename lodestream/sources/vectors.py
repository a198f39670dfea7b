"""A Python data source: NumPy matrices (.npy) in a folder, one partition for each file.

Files are opened by the executors, so the folder has to be one that all machines
mount. Rows are read a piece at a time from a memory map.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 4096


class NpyFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class NpyReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [NpyFile(str(p)) for p in sorted(Path(self.folder).glob("*.npy"))] or [NpyFile("")]

    def read(self, partition: NpyFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows = np.load(partition.path, mmap_mode="r")
        name = Path(partition.path).name
        for at in range(0, len(rows), ROWS):
            part = np.ascontiguousarray(rows[at:at + ROWS], np.float64)
            ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))],
                names=["file", "row", "vector"])


class NpySource(DataSource):
    """spark.dataSource.register(NpySource), then spark.read.format("npy").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row bigint, vector array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"])
