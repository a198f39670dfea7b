"""A Python data source for batches of vectors: read with pushed filters, written in two phases, streamed both ways.

    spark.dataSource.register(VectorLog)
    spark.read.format("vectorlog").load(folder)
    df.write.format("vectorlog").mode("append").save(folder)
    spark.readStream.format("vectorlog").load(folder)

A folder has files of rows (ids and a matrix) and numbered manifests, each of
which lists the files that one write has added, with the range of their ids.
Only what a manifest lists is there. A task writes files of its own and reports
them; when all have ended well, the driver adds one manifest, in one step, and
else it deletes what they had written. The manifests' numbers are a stream's
offsets. Executors and driver open files by path, so the folder has to be one
that all machines mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import datasource as ds

#: Rows of a file, at most.
ROWS = 1 << 16


@dataclass
class Part(ds.WriterCommitMessage, ds.InputPartition):
    """A file of rows of one width; low and high: of its ids."""
    file: str
    rows: int
    low: int
    high: int


@dataclass
class Written(ds.WriterCommitMessage):
    parts: list[Part]


def manifests(folder: str) -> list[dict]:
    """In the order of their numbers, from 0 without a gap."""
    found = []
    while (path := Path(folder) / f"manifest-{len(found):08d}.json").exists():
        found.append(json.loads(path.read_text()))
    return found


def _parts(found: list[dict]) -> list[Part]:
    """Of all manifests: the files since the last one that replaced what was there."""
    start = max((i for i, m in enumerate(found) if m["replaces"]), default=0)
    return [Part(**p) for m in found[start:] for p in m["parts"]]


def publish(folder: str, parts: list[Part], replaces: bool, batch: str | None = None) -> bool:
    """Add a manifest; false if there is one of this batch already, whose rerun this is."""
    own = Path(folder) / f".{uuid.uuid4().hex}"
    try:
        while True:
            found = manifests(folder)
            if batch is not None and any(m["batch"] == batch for m in found):
                return False
            own.write_text(json.dumps({"parts": [asdict(p) for p in parts], "replaces": replaces, "batch": batch}))
            try:
                os.link(own, Path(folder) / f"manifest-{len(found):08d}.json")  # fails if another writer was faster
                return True
            except FileExistsError:
                continue
    finally:
        own.unlink(missing_ok=True)


def _delete(folder: str, messages) -> None:
    for m in messages:
        for p in m.parts if m is not None else ():
            (Path(folder) / p.file).unlink(missing_ok=True)


_TESTS = {"EqualTo": np.equal, "GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal, "LessThan": np.less, "LessThanOrEqual": np.less_equal}


class LogReader(ds.DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters):
        """Comparisons of ids with whole numbers are done here, by file and by row; others are left to Spark."""
        for f in filters:
            if type(f).__name__ in _TESTS and f.attribute == ("id",) and isinstance(f.value, int):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def _may_match(self, p: Part) -> bool:
        edge = {"EqualTo": lambda v: p.low <= v <= p.high, "GreaterThan": lambda v: p.high > v, "GreaterThanOrEqual": lambda v: p.high >= v,
                "LessThan": lambda v: p.low < v, "LessThanOrEqual": lambda v: p.low <= v}
        return all(edge[name](value) for name, value in self.tests)

    def partitions(self):
        return [p for p in _parts(manifests(self.folder)) if self._may_match(p)] or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.folder, partition, self.tests)


def rows_of(folder: str, part: Part, tests) -> Iterator[pa.RecordBatch]:
    if not part.file:
        return
    with np.load(Path(folder) / part.file) as held:
        ids, matrix = held["id"], held["vector"]
    keep = np.ones(len(ids), bool)
    for name, value in tests:
        keep &= _TESTS[name](ids, value)
    ids, matrix = ids[keep], matrix[keep]
    for at in range(0, len(ids), 4096):
        some = np.ascontiguousarray(matrix[at:at + 4096])
        ends = np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + 4096]), pa.ListArray.from_arrays(pa.array(ends), pa.array(some.ravel()))], names=["id", "vector"])


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """Files of at most ROWS rows of one width; what was written is deleted if the task fails."""
    parts: list[Part] = []
    held: dict[int, list] = {}

    def put(rows: list) -> None:
        name = f"rows-{uuid.uuid4().hex}.npz"
        ids = np.array([i for i, _ in rows], np.int64)
        parts.append(Part(name, len(rows), int(ids.min()), int(ids.max())))
        with open(Path(folder) / name, "xb") as f:
            np.savez(f, id=ids, vector=np.array([v for _, v in rows], np.float64).reshape(len(rows), -1))

    Path(folder).mkdir(parents=True, exist_ok=True)
    try:
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist()):
                if i is None or v is None or None in v:
                    raise ValueError("ids, vectors and their components can't be null")
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == ROWS:
                    put(held.pop(len(v)))
        for rows in held.values():
            put(rows)
    except BaseException:
        _delete(folder, [Written(parts)])
        raise
    return Written(parts)


class LogWriter(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, replaces: bool):
        self.folder, self.replaces = folder, replaces

    def write(self, iterator):
        return _write(self.folder, iterator)

    def commit(self, messages):
        publish(self.folder, [p for m in messages if m is not None for p in m.parts], self.replaces)

    def abort(self, messages):
        _delete(self.folder, messages)


class LogStreamWriter(ds.DataSourceStreamArrowWriter):
    """stream: a name that stays when the stream is started again, so that a batch that is rerun counts once."""

    def __init__(self, folder: str, stream: str):
        self.folder, self.stream = folder, stream

    def write(self, iterator):
        return _write(self.folder, iterator)

    def commit(self, messages, batchId):
        if not publish(self.folder, [p for m in messages if m is not None for p in m.parts], False, f"{self.stream}-{batchId}"):
            _delete(self.folder, messages)

    def abort(self, messages, batchId):
        _delete(self.folder, messages)


class LogStreamReader(ds.DataSourceStreamReader):
    """Offsets are numbers of manifests. A manifest that replaces others adds its rows to a stream; what it replaced has been read."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"manifest": 0}

    def latestOffset(self) -> dict:
        return {"manifest": len(manifests(self.folder))}

    def partitions(self, start: dict, end: dict):
        found = manifests(self.folder)[start["manifest"]:end["manifest"]]
        return [Part(**p) for m in found for p in m["parts"]] or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.folder, partition, ())

    def commit(self, end: dict) -> None:
        pass


class VectorLog(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorlog"

    def schema(self) -> str:
        return "id bigint, vector array<double>"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options["path"], self.options.get("stream", "stream"))
