"""Row patterns against Python's regular expressions over one letter a row."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestream.operators.patterns import alt, many, match_at, match_rows, program, row, seq

A, B, C = row("a"), row("b"), row("c")
AB = row("ab")  # rows that are an a or a b
PATTERNS = [
    (seq(A, many(B, 1), C), "ab+c"),
    (seq(A, many(B), many(C, 0, 1)), "ab*c?"),
    (seq(many(A, 2, 3), many(alt(B, C), 1, None, greedy=False), A), "a{2,3}(?:b|c)+?a"),
    (many(seq(A, many(B, 0, 2)), 2), "(?:ab{0,2}){2,}"),
    (alt(seq(A, B), seq(A, B, C), many(C, 2)), "(?:ab|abc|cc+)"),
    (seq(AB, many(AB, 1, 4), B), "[ab][ab]{1,4}b"),
    (seq(many(many(A)), B), "(?:a*)*b"),
    (many(A, 0, 2), "a{0,2}"),
    (seq(A, many(B, 0, None, greedy=False), B), "ab*?b"),
]


def spans(pattern, text, past_last):
    """(start, end) of matches that aren't empty."""
    compiled = re.compile(pattern)
    if not past_last:
        return [m.span() for i in range(len(text)) if (m := compiled.match(text, i)) and m.group()]
    found, at = [], 0
    while at < len(text):
        m = compiled.match(text, at)
        if m and m.group():
            found.append(m.span())
            at = m.end()
        else:
            at += 1
    return found


@pytest.mark.parametrize("pattern, expression", PATTERNS)
def test_automaton(pattern, expression):
    bits = {"a": 0, "b": 1, "c": 2, "ab": 3}
    steps, rng = program(pattern, bits), random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("aabbc") for _ in range(rng.randint(1, 14)))
        masks = [1 << bits[x] | (8 if x in "ab" else 0) for x in text]
        for i in range(len(text)):
            m, got = re.compile(expression).match(text, i), match_at(steps, masks, i, len(text))
            assert len(got or ()) == (len(m.group()) if m else 0)
            assert all(x in name for x, name in zip(text[i:], got or ()))


def table(spark, texts):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), x, i) for k, t in texts.items() for i, x in enumerate(t)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x string, n long").repartition(5)


def conditions():
    return {name: F.col("x") == name for name in ("a", "b", "c")} | {"ab": F.col("x").isin("a", "b")}


@pytest.mark.parametrize("past_last", [True, False])
@pytest.mark.parametrize("pattern, expression", PATTERNS[:6])
def test_keys_of_a_table(spark, pattern, expression, past_last):
    rng = random.Random(1)
    texts = {f"k{i}": "".join(rng.choice("aabbc") for _ in range(rng.choice([1, 3, 40]))) for i in range(30)}
    found = match_rows(table(spark, texts), ["k"], ["ts"], conditions(), pattern, past_last)
    got = sorted((r.k, r.a, r.b + 1, r.n) for r in found.groupBy("k", "match_first", "match_last").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("n")).collect())
    assert got == sorted((k, a, b, b - a) for k, t in texts.items() for a, b in spans(expression, t, past_last))


@pytest.mark.parametrize("past_last", [True, False])
def test_within_in_stretches_of_time(spark, past_last):
    """Rows an hour apart; matches of five rows at most, whose keys go over many stretches."""
    rng = random.Random(2)
    texts = {f"k{i}": "".join(rng.choice("aabbc") for _ in range(200)) for i in range(5)}
    found = match_rows(table(spark, texts), ["k"], ["ts"], conditions(), seq(A, many(B, 0), C), past_last, within=4 * 3600)
    got = sorted((r.k, r.a, r.b + 1) for r in found.groupBy("k", "match_first").agg(F.min("n").alias("a"), F.max("n").alias("b")).collect())
    assert got == sorted((k, a, b) for k, t in texts.items() for a, b in spans("ab{0,3}c", t, past_last))
    assert len(got) > 50


def test_nulls_ties_and_empty(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), ("k", None, "a"), ("k", 1, None), ("k", 2, "a"), ("k", 3, "b"), ("k", 3, "b")]
    df = spark.createDataFrame(rows, "k string, n long, x string")
    got = match_rows(df, ["k"], ["n"], conditions(), seq(A, many(B, 1)))
    assert sorted((r.k or "", r.n, r.match_symbol) for r in got.collect()) == [("", 1, "a"), ("", 2, "b"), ("k", 2, "a"), ("k", 3, "b"), ("k", 3, "b")]
    assert match_rows(df.limit(0), ["k"], ["n"], conditions(), A).collect() == []


def test_rows_of_a_key_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = {"p": "abbbbbbbbc" * 3, "q": "ab", "r": "c"}
        found = match_rows(table(spark, texts), ["k"], ["ts"], conditions(), seq(A, many(B, 1), C))
        assert sorted((r.k, r.a) for r in found.groupBy("k", "match_first").agg(F.min("n").alias("a")).collect()) == [("p", 0), ("p", 10), ("p", 20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
