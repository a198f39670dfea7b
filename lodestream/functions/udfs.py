"""User-defined functions of each kind. Built-in functions are to be preferred; these show the way where none will do.

Each is made on demand, as making one asks for a session.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Whole texts that a Python worker gets at once, and bytes of them (where Spark has that setting): a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches() -> None:
    """Lower the session's Arrow batches to these bounds; the settings stay, as plans that were made under them run later."""
    conf = SparkSession.active().conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = (conf.get(key) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def plain(text: str | None) -> str | None:
    """text without accents and other marks: canonically decomposed, marks dropped. No built-in function decomposes letters."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def plain_by_row():
    """plain as a function whose rows go one by one."""
    return F.udf(plain, "string", useArrow=False)


def plain_by_arrow():
    """The same, carried by Arrow."""
    bounded_batches()
    return F.udf(plain, "string", useArrow=True)


def clipped():
    """Values within 0 to 100."""
    def clip(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.clip(0.0, 100.0)
    return F.pandas_udf(clip, "double")


def byte_length():
    """Bytes of a text in UTF-8; null for null."""
    def length(texts: pa.Array) -> pa.Array:
        return pc.cast(pc.binary_length(pc.cast(texts, pa.binary())), pa.int64())
    bounded_batches()
    return F.arrow_udf(length, "long")


def median_deviation():
    """The median of the distances from the median; an aggregate of groups that fit a task. Nulls don't count."""
    def deviation(values: pd.Series) -> float:
        v = values.dropna().to_numpy()
        return float(np.median(np.abs(v - np.median(v)))) if len(v) else None
    return F.pandas_udf(deviation, "double")


class Pieces:
    """One row for each piece of a text between separators."""

    def eval(self, text: str, separator: str):
        for i, x in enumerate(text.split(separator) if text is not None else ()):
            yield x, i


def pieces():
    return F.udtf(Pieces, returnType="part string, place int")
