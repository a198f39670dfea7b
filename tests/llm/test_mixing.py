import hashlib
import math
import re
from collections import Counter

import pytest

from lodestream.llm import mixing


def expected(rows, seed=mixing.SEED, power=0.5):
    n = Counter(s for _, s in rows)
    w = {s: c**power for s, c in n.items()}
    out = Counter()
    for i, s in rows:
        rate = len(rows) * w[s] / sum(w.values()) / n[s]
        pieces = max(1, math.ceil(rate / mixing.PIECE))
        total = 0
        for k in range(1, pieces + 1):
            u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = cdf = math.exp(-rate / pieces)
            j = 0
            while cdf <= u and j <= mixing.TERMS:
                j += 1
                p *= rate / pieces / j
                cdf += p
            total += j
        out[(i, s)] += total
    return +out


def test_counts(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(None, None), (5, "rare")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"))
    assert Counter((r.doc_id, r.source) for r in got.collect()) == expected(rows)


def test_rates_above_a_piece(spark):
    rows = [(i, "big") for i in range(2000)] + [(9000 + i, "small") for i in range(3)]
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("absent", 2.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, total=4000).collect())
    assert got["big"] == pytest.approx(1000, abs=130) and got["small"] == pytest.approx(3000, abs=250)


def test_odd_rows(odd, empty, clashing):
    got = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.source) for r in got) == expected([(r.doc_id, r.source) for r in odd.collect()])
    assert mixing.mix(empty).collect() == []
    assert set(clashing.columns) < set(mixing.mix(clashing).columns)


def test_columns_of_any_name_are_kept(odd):
    from pyspark.sql import functions as F
    taken = ["mix_n", "mix_source", "mix_rate", "mix_pieces", "mix_cdf", "mix_id", "mix_row", "mix_copy", "mix_source_of", "of", "a.b"]
    docs = odd
    for name in taken:
        docs = docs.withColumn(name, F.lit(7))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "copy", "shuffle_key"]
    assert all(r[name] == 7 for r in got.collect() for name in taken)
    assert Counter((r.doc_id, r.source) for r in got.collect()) == expected([(r.doc_id, r.source) for r in odd.collect()])
    replaced = mixing.mix(odd.withColumn("Copy", F.lit(70)))
    assert replaced.columns == [*odd.columns, "copy", "shuffle_key"] and {r.copy for r in replaced.collect()} < set(range(20))


def test_plan_is_native(spark, sf_dir):
    plan = mixing.op3_poisson_mix(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "RDD" not in plan
