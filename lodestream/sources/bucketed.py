"""Co-partitioned tables: bucketed and sorted by a key, so that joins and groups on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lodestream.sources.shared import new_path


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Write df as a table of `buckets` files, one a bucket, sorted by the keys; its name.

    Tables of equal keys' types and buckets join bucket by bucket. Rows are dealt
    by the hash that buckets go by, so each task writes one whole bucket; a key
    with a large part of the rows is one bucket's, which is what no shuffle means:
    choose keys without such values. name, path: by default new ones in the
    shared folder.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
     .option("path", path or new_path(df.sparkSession, name)).saveAsTable(name))
    return name
