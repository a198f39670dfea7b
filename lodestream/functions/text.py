"""Scalar text and vector expressions in built-in functions."""

from __future__ import annotations

from pyspark.sql import functions as F


def word_count(text):
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def dot(a, b):
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def url_host(url):
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)
