from collections import Counter


import corpus_pipeline
from lodestream.llm import toxicity
from tests.llm import test_decontaminate, test_mixing, test_near_copies, test_token_files


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        outs[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == columns
    toxic = {r.doc_id for r in toxicity.op2_toxicity(spark, d).collect() if r.predicted}
    rows = [r for i, r in sorted(before.items()) if i not in toxic]
    assert {r.doc_id for r in outs["toxicity"]} == {r.doc_id for r in rows}

    groups = test_near_copies.brute([r.text for r in rows])
    rows = [r for k, r in enumerate(rows) if groups[k] == k]
    assert sorted(r.doc_id for r in outs["simhash_near_dedup"]) == [r.doc_id for r in rows]

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    hit = {i for i, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in hit]
    assert sorted(r.doc_id for r in outs["benchmark_decontamination"]) == [r.doc_id for r in rows]

    counts = test_mixing.expected([(r.doc_id, r.source) for r in rows])
    assert Counter((r.doc_id, r.source) for r in outs["mixing"]) == counts

    rows = sorted((r for r in outs["mixing"]), key=lambda r: r.doc_id)
    test_token_files.check(rows, outs["token_output"])
    assert len(outs["token_output"]) == len(rows)
