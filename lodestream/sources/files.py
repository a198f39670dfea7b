"""File formats by name, read with a given schema and written in place of what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Format to the options that keep a round trip exact.
FORMATS = {
    "parquet": {},
    "orc": {},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "csv": {"header": "true", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "xml": {"rowTag": "row", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}


def read(spark: SparkSession, path: str, kind: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.format(kind).options(**FORMATS[kind])
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str, by: list[str] | None = None) -> None:
    """by: columns of the folders, so that a filter on them reads only those."""
    writer = df.write.format(kind).options(**FORMATS[kind]).mode("overwrite")
    (writer.partitionBy(*by) if by else writer).save(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """df has one column of texts without line breaks."""
    df.write.mode("overwrite").text(path)


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content): each file as one row; for files that fit a task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, nChannels, mode, data) of each image that can be decoded."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
