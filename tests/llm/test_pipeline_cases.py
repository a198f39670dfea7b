"""Each stage on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import test_mixing

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, empty, name, stage):
    docs = odd.withColumnsRenamed({"lang": "tox_result", "n_chars": "mix_n"}) if name in ("toxicity", "mixing") else odd.withColumnsRenamed({"lang": "dc_row", "n_chars": "row"})
    got = stage(spark, docs, SF)
    if name == "token_output":
        assert got.count() == docs.count()
    else:
        assert got.columns == docs.columns
        want = rows(docs)
        assert all(r in want for r in rows(got))
        if name == "toxicity":  # none of the odd texts is toxic
            assert rows(got) == want
        elif name == "mixing":
            assert Counter((r.doc_id, r.source) for r in got.collect()) == test_mixing.expected([(r.doc_id, r.source) for r in docs.collect()])
        else:
            assert got.count() == {"simhash_near_dedup": 5, "benchmark_decontamination": 8}[name]
    assert stage(spark, empty, SF).count() == 0
