"""Queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import text as tx
from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query(r"""
SELECT lang, count(*) AS n, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS words, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY lang""")
def text_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tx.word_count("text")).alias("words"), F.sum(F.length("text")).alias("chars"))


@query(r"""
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1""")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(tx.url_host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id""")
def conversation_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count(F.lit(1)).alias("n"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"), "n")


@query("""
SELECT label, count(*) AS n, sum(list_sum(list_transform(embedding, lambda x: floor(1000 * x::DOUBLE)))::BIGINT)::BIGINT AS total_milli FROM embeddings GROUP BY label""")
def embedding_labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + F.floor(1000 * x.cast("double")))).alias("total_milli"))


@query("""
SELECT md5(text) AS text_md5, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_copies(spark, sf_dir):
    return (table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5"))
            .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
