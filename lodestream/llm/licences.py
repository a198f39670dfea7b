"""Licence scans, in DataFrame functions only.

Base places are those where a phrase's words stand consecutively. Besides, an
exact set-similarity join compares every text block with two catalogues: short
licence statements, and whole licence texts and notices. Blocks are windows of words
whatever the line breaks, so many apart that every run of up to BLOCK - STRIDE + 1
words (of whole texts LONG_BLOCK - LONG_STRIDE + 1) lies in one whole. A block
matches a template if it contains at least THRESHOLD of the template's distinct
words (all of a template of up to 12, all but one of up to 24), or LONG_THRESHOLD of
a whole text's, of which some ten to thirty can be missing or changed. Words are
ordered by their frequency over the whole corpus, rarest first. A match needs
`need` of a template's words, so it holds one of the first size - need + 1 in that
order (prefix filter); it has `need` words of the catalogue itself (length filter);
and from the place of its first shared prefix word on, both sides have enough words
left (positional filter). What passes is counted exactly. Words that the corpus
doesn't hold, and templates too few of whose words it holds, drop out beforehand.

The catalogues are parameters, not data: their words are literals of the plan, which
grows with those that the corpus holds, and their corpus frequencies come to the driver.

Defined cases: a null text counts as empty: no words, no places, score 0; each
row is scanned by itself, so null ids, ties, repeated rows and empty tables need
no rule; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import stored, table

# Fixed values of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights"),
)
#: Whole texts and notices. Those of the GPL family differ in a word or two, so statements above and phrases tell them apart.
LONG_TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
     "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as "
     "is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
     "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
     "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
     "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
     "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
     "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
     "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
     "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
     "materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied "
     "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
     "shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but "
     "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory "
     "of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
     "even if advised of the possibility of such damage"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
     "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
     "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
     "specific language governing permissions and limitations under the license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
     "can obtain one at http mozilla org mpl 2 0"),
)
LONG_THRESHOLD = 0.8
LONG_BLOCK, LONG_STRIDE = 448, 224
#: Over 0.9: a GPL statement has nine of the ten words of an LGPL one.
THRESHOLD = 0.92
BLOCK, STRIDE = 48, 24
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normalised(text):
    """Words, lower-cased A-Z, between single spaces and with one at either end."""
    # only these two other letters have lower-case forms with A-Z in them
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(plain), F.lit(" ")), _NOT_WORD, " ")


def _held(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column that is computed once a row, however often it is used: the optimizer doesn't fold a generator into what follows."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _word_list(norm):
    return F.filter(F.split(norm, " "), lambda w: w != "")


def _places(norm, ws, phrase: str):
    parts = phrase.split()
    last = F.size(ws) - len(parts)
    at = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                  lambda i: _all(F.get(ws, i + k) == p for k, p in enumerate(parts)))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<int>"))


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _strings(values):
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def frequencies(docs: DataFrame, templates, norm_col: str = "norm") -> dict[str, int]:
    """How many texts hold each of the templates' words; those that none holds are absent."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = (docs.select(F.explode(F.array_intersect(F.split(norm_col, " "), _strings(vocabulary))).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    return {r.word: r.n for r in counts.collect()}  # of the catalogue's words only


def template_matches(docs: DataFrame, seen: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, stride: int = STRIDE,
                     id_cols=("lic_row", "lic_more"), norm_col: str = "norm") -> DataFrame:
    """(id_cols, block, label, containment): every block of docs that meets a template's threshold. seen: `frequencies` of docs; norm_col: normalised texts."""
    order = sorted({w for _, t in templates for w in t.split() if w in seen}, key=lambda w: (seen[w], w))
    rank = {w: i for i, w in enumerate(order)}
    entries, prefix_words = [], set()
    for label, text in templates:
        distinct = set(text.split())
        ranks = sorted(rank[w] for w in distinct if w in rank)
        need = math.ceil(threshold * len(distinct) - 1e-9)
        if len(ranks) < need:  # the corpus doesn't hold enough of its words
            continue
        # words that no text holds come first of all, so they are in the prefix
        prefix = ranks[:len(ranks) - need + 1]
        prefix_words |= {order[r] for r in prefix}
        entries.append(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, ranks)).alias("ranks"), F.lit(len(distinct)).alias("words"), F.lit(need).alias("need"), F.array(*map(F.lit, prefix)).alias("prefix")))
    spark = docs.sparkSession
    if not entries:
        return docs.where(F.lit(False)).select(*id_cols, F.lit(0).alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment"))
    catalogue = spark.range(1).select(F.explode(F.array(*entries)).alias("t")).select("t.*").withColumn("rank", F.explode("prefix"))
    prefix_words = sorted(prefix_words)

    holds_one = None
    for w in prefix_words:
        c = F.contains(norm_col, F.lit(f" {w} "))
        holds_one = c if holds_one is None else holds_one | c
    worded = _held(docs.where(holds_one).select(*id_cols, norm_col), "ws", _word_list(F.col(norm_col)))
    last = F.greatest(F.lit(0), F.ceil((F.size("ws") - block) / stride)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("ws", i * stride + 1, block))
    blocks = worded.select(*id_cols, F.posexplode(cut).alias("block", "tokens")).where(F.arrays_overlap("tokens", _strings(prefix_words)))
    mine = F.filter(F.transform(_strings(order), lambda w, i: F.when(F.array_contains("tokens", w), i)), lambda i: i.isNotNull())
    blocks = blocks.select(*id_cols, "block", mine.alias("mine"))
    probes = blocks.withColumn("rank", F.explode("mine")).join(catalogue, "rank")
    left = lambda ranks: F.size(ranks) - F.array_position(ranks, F.col("rank")).cast("int") + 1
    kept = (probes.where(F.size("mine") >= F.col("need"))
            .where(F.get(F.array_intersect("prefix", "mine"), F.lit(0)) == F.col("rank"))  # its first shared prefix word
            .where(F.least(left(F.col("ranks")), left(F.col("mine"))) >= F.col("need")))
    overlap = F.size(F.array_intersect("ranks", "mine"))
    return kept.where(overlap >= F.col("need")).select(*id_cols, "block", "label", (overlap / F.col("words")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places, base_labels, labels, score) of each row; places: word starts of all phrases."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the row's own hashes stand for it: equal rows have equal results
    rows = rows.withColumn("lic_row", F.xxhash64("doc_id", "text")).withColumn("lic_more", F.xxhash64(F.lit("more"), "text", "doc_id"))
    rows = _held(rows, "norm", normalised(F.col("text")))
    hit = _any(F.contains("norm", F.lit(f" {p} ")) for p in PHRASES)
    n_words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1
    worded = _held(rows, "lic_words", F.when(hit, _word_list(F.col("norm"))))
    told = worded.select(
        "doc_id", "lic_row", "lic_more", F.greatest(n_words, F.lit(0)).cast("long").alias("n_words"),
        F.when(F.col("lic_words").isNotNull(), F.array(*(F.struct(F.lit(label).alias("label"), _places(F.col("norm"), F.col("lic_words"), p).alias("at")) for p, label in PHRASES.items()))).alias("found"))
    seen = frequencies(rows, TEMPLATES + LONG_TEMPLATES)
    found = template_matches(rows, seen).unionByName(template_matches(rows, seen, LONG_TEMPLATES, LONG_THRESHOLD, LONG_BLOCK, LONG_STRIDE))
    matched = (found.groupBy("lic_row", "lic_more")
               .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
               .withColumnsRenamed({"lic_row": "lic_key", "lic_more": "lic_also"}))
    both = told.join(stored(matched, "licences"), (F.col("lic_row") == F.col("lic_key")) & (F.col("lic_more") == F.col("lic_also")), "left")
    hits = F.filter("found", lambda x: F.size(x["at"]) > 0)
    base = F.coalesce(F.transform(hits, lambda x: x["label"]), F.array().cast("array<string>"))
    places = F.coalesce(F.flatten(F.transform(hits, lambda x: x["at"])), F.array().cast("array<int>"))
    both = both.select("doc_id", "n_words", base.alias("base"), places.alias("places"), "more", "best")
    return both.select(
        F.col("doc_id").alias(id_col), "n_words", "places",
        F.array_sort(F.array_distinct("base")).alias("base_labels"),
        F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _any(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def op6_licence_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _oracle() -> str:
    """The same rules without filters: every phrase at every place, every block against every template."""
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    tokens = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, text, {tokens("text")} AS w FROM documents),
phrases(phrase, label) AS (VALUES {values(PHRASES.items())}),
templates(label, template) AS (VALUES {values(TEMPLATES)}),
long_templates(label, template) AS (VALUES {values(LONG_TEMPLATES)}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM d, (SELECT label, string_split(phrase, ' ') AS p FROM phrases), generate_series(1, len(w)) AS g(i)
  WHERE w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(w[i * {STRIDE} + 1:i * {STRIDE} + {BLOCK}]) AS w FROM d, generate_series(0, greatest(0, ceil((len(w) - {BLOCK}) / {STRIDE}))::BIGINT) AS g(i)),
long_blocks AS (SELECT doc_id, list_distinct(w[i * {LONG_STRIDE} + 1:i * {LONG_STRIDE} + {LONG_BLOCK}]) AS w
  FROM d, generate_series(0, greatest(0, ceil((len(w) - {LONG_BLOCK}) / {LONG_STRIDE}))::BIGINT) AS g(i)),
matches AS (
  SELECT doc_id, label, len(list_intersect(w, t))::DOUBLE / len(t) AS share
  FROM blocks, (SELECT label, list_distinct(string_split(template, ' ')) AS t FROM templates)
  WHERE len(list_intersect(w, t)) >= ceil({THRESHOLD} * len(t) - 1e-9)
  UNION ALL
  SELECT doc_id, label, len(list_intersect(w, t))::DOUBLE / len(t) AS share
  FROM long_blocks, (SELECT label, list_distinct(string_split(template, ' ')) AS t FROM long_templates)
  WHERE len(list_intersect(w, t)) >= ceil({LONG_THRESHOLD} * len(t) - 1e-9)),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM matches) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM matches GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


QUERIES = {"op6_licence_scan": op6_licence_scan}
ORACLE_SQL = {"op6_licence_scan": _oracle()}
