"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go; of each group of near-duplicates one document stays;
documents that hold benchmark items go; sources are mixed to target weights,
where a document can come out several times or not at all; what is left is
written as a token file, whose documents the last stage returns.

Every stage works on all rows it is given and keeps the columns of `documents`
but for the last. Nulls, empty texts, ties, repeated rows and empty tables are
treated as the operators' docstrings say.
"""

from __future__ import annotations

from contextlib import nullcontext

from lodestream.llm import decontaminate, mixing, near_copies, token_files, toxicity
from lodestream.llm.common import crc_mod, own_path, scratch, table


def drop_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score under one half; learns from the same labelled rows as the query."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), keep=crc_mod("doc_id", 5) != 0)
    column = "tox_result" + "_" * max(map(len, docs.columns))  # no name of the table's
    scored = toxicity.with_toxicity(docs, model, out_col=column, spans=False)
    return scored.where(scored[column].score < 0.5).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One of each group that near SimHash fingerprints or similar sets of shingles link."""
    return near_copies.one_of_each(docs, by_simhash=True)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    longer = "_" * max(map(len, docs.columns))  # no names of the table's
    return mixing.mix(docs, out_copy="mix_copy" + longer, out_key="mix_key" + longer).select(*docs.columns)


def write_tokens(spark, docs, sf_dir):
    return token_files.digests_of(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Not expressible in SQL: models are fitted and fingerprints linked. tests/llm holds it against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. What stages stored on the way is deleted, but their results and the token file."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = own_path(spark, name)
        with scratch(spark) if name != STAGES[-1][0] else nullcontext():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
