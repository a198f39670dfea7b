"""Queries of scalar functions: strings, dates, numbers, JSON, arrays, maps, structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import text as tx
from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query("""
SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS name_length, substring(p_name, 3, 5) AS part_of, replace(p_type, 'A', '*') AS starred,
  trim('  ' || p_brand || ' ') AS trimmed, concat(p_brand, '/', p_type) AS joined, lpad(p_size::VARCHAR, 6, '0') AS padded, rpad(p_brand, 12, '.') AS dotted,
  reverse(p_brand) AS backwards, repeat('ab', 2) || left(p_type, 3) || right(p_type, 2) AS ends, instr(p_type, 'E')::INTEGER AS first_e
FROM part""".replace("length(p_name)", "length(p_name)::INTEGER"))
def strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.length("p_name").alias("name_length"), F.substring("p_name", 3, 5).alias("part_of"),
        F.replace("p_type", F.lit("A"), F.lit("*")).alias("starred"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.concat_ws("/", "p_brand", "p_type").alias("joined"), F.lpad(F.col("p_size").cast("string"), 6, "0").alias("padded"), F.rpad("p_brand", 12, ".").alias("dotted"),
        F.reverse("p_brand").alias("backwards"), F.concat(F.repeat(F.lit("ab"), 2), F.left("p_type", F.lit(3)), F.right("p_type", F.lit(2))).alias("ends"),
        F.instr("p_type", "E").alias("first_e"))


@query("SELECT doc_id, md5(lower(text)) AS lower_md5, sha256(lower(text)) AS lower_sha, n_chars = length(text) AS counted FROM documents")
def lower_and_digests(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(low).alias("lower_md5"), F.sha2(low, 256).alias("lower_sha"), (F.col("n_chars") == F.length("text")).alias("counted"))


@query("""
SELECT doc_id, string_split(text, ' ')[1] AS first_piece, split_part(text, ' ', 3) AS third_piece, len(string_split(text, chr(10)))::INTEGER AS n_lines FROM documents""")
def splits(spark, sf_dir):
    pieces = F.split("text", " ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", pieces[0].alias("first_piece"), F.split_part("text", F.lit(" "), F.lit(3)).alias("third_piece"), F.size(F.split("text", "\n")).alias("n_lines"))


@query(r"""
SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_extract(url, '\?(.*)$', 1) AS query, regexp_matches(url, '^https') AS is_secure,
  len(regexp_extract_all(html, '<[a-zA-Z]'))::INTEGER AS n_tags, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS plain_md5 FROM pages""")
def regular_expressions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "[0-9]+", "#").alias("masked"), F.regexp_extract("url", r"\?(.*)$", 1).alias("query"), F.rlike("url", F.lit("^https")).alias("is_secure"),
        F.size(F.regexp_extract_all("html", F.lit("<[a-zA-Z]"), F.lit(0))).alias("n_tags"), F.md5(F.regexp_replace("html", "<[^>]*>", " ")).alias("plain_md5"))


@query("""
SELECT p_partkey, levenshtein(p_name, p_type)::INTEGER AS distance, CASE WHEN levenshtein(p_name, p_brand) <= 9 THEN levenshtein(p_name, p_brand) ELSE -1 END::INTEGER AS if_near
FROM part""")
def edit_distance(spark, sf_dir):
    """Of part names from types, and from brands as far as they are near."""
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), F.levenshtein("p_name", "p_brand", 9).alias("if_near"))


@query("""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d,
  dayofyear(o_orderdate)::INTEGER AS doy, week(o_orderdate)::INTEGER AS w, (dayofweek(o_orderdate) + 1)::INTEGER AS dow, hour(o_orderdate)::INTEGER AS h,
  date_trunc('month', o_orderdate)::DATE AS month_start, last_day(o_orderdate::DATE) AS month_end,
  (o_orderdate + INTERVAL 3 MONTH)::DATE AS in_a_quarter, (o_orderdate - INTERVAL 10 DAY)::DATE AS before, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS shown
FROM orders""")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("w"),
        F.dayofweek(d).alias("dow"), F.hour(d).alias("h"), F.date_trunc("month", d).cast("date").alias("month_start"), F.last_day(d).alias("month_end"),
        (d + F.expr("INTERVAL 3 MONTH")).cast("date").alias("in_a_quarter"), (d - F.expr("INTERVAL 10 DAY")).cast("date").alias("before"), F.date_format(d, "yyyy/MM/dd HH:mm").alias("shown"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS days,
  (year(l_shipdate) * 12 + month(l_shipdate) - year(o_orderdate) * 12 - month(o_orderdate))::INTEGER AS month_steps
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_differences(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    months = lambda c: F.year(c) * 12 + F.month(c)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").alias("days"), (months("l_shipdate") - months("o_orderdate")).alias("month_steps"))


@query("""
SELECT event_id, sqrt(abs(value)) AS root, ln(abs(value) + 1) AS natural_log, log10(abs(value) + 1) AS tens, exp(value / 1000) AS e, pow(value, 2) AS square,
  ceil(value)::BIGINT AS up, floor(value)::BIGINT AS down, sign(value)::INTEGER AS sgn, greatest(value, 10.0) AS most, least(value, 10.0) AS least_of
FROM events""".replace("10.0", "10.0::DOUBLE"))
def mathematics(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.sqrt(F.abs(v)).alias("root"), F.ln(F.abs(v) + 1).alias("natural_log"), F.log10(F.abs(v) + 1).alias("tens"), F.exp(v / 1000).alias("e"), F.pow(v, F.lit(2)).alias("square"),
        F.ceil(v).alias("up"), F.floor(v).alias("down"), F.signum(v).cast("int").alias("sgn"), F.greatest(v, F.lit(10.0)).alias("most"), F.least(v, F.lit(10.0)).alias("least_of"))


@query("""
SELECT p_partkey, round(p_retailprice::DECIMAL(12,2), 1)::DECIMAL(12,1) AS tenths, (p_partkey / 7)::DOUBLE AS share, p_partkey // 7 AS whole, p_partkey % 7 AS rest,
  (p_size / nullif(p_size % 3, 0))::DOUBLE AS guarded, coalesce(nullif(p_size, 1), -1) AS filled, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class,
  p_partkey & 12 AS masked, p_partkey << 2 AS doubled FROM part""")
def arithmetic(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.col("p_retailprice").cast("decimal(12,2)"), 1).cast("decimal(12,1)").alias("tenths"), (k / 7).alias("share"), F.expr("p_partkey div 7").alias("whole"), (k % 7).alias("rest"),
        (s / F.nullif(s % 3, F.lit(0))).alias("guarded"), F.coalesce(F.nullif(s, F.lit(1)), F.lit(-1)).alias("filled"),
        F.when(s < 10, "small").when(s < 30, "middle").otherwise("large").alias("class"), k.bitwiseAND(12).alias("masked"), F.shiftleft(k, 2).alias("doubled"))


@query("""
SELECT p_partkey, try_cast(substr(p_brand, 7) AS INTEGER) AS brand_number, try_cast(p_name AS DOUBLE) AS not_a_number, p_size::VARCHAR AS size_text,
  floor(p_retailprice)::INTEGER AS whole_price, try_cast('2024-02-30' AS DATE) AS no_date FROM part""")
def casts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.substr("p_brand", F.lit(7)).try_cast("int").alias("brand_number"), F.col("p_name").try_cast("double").alias("not_a_number"), F.col("p_size").cast("string").alias("size_text"),
        F.floor("p_retailprice").cast("int").alias("whole_price"), F.lit("2024-02-30").try_cast("date").alias("no_date"))


@query("""
SELECT event_id, (props->>'$.k')::INTEGER AS typed, (props->>'$.k')::BIGINT AS from_variant, props->>'$.absent' AS absent,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS made FROM events""")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("typed"), F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("from_variant"),
        F.get_json_object("props", "$.absent").alias("absent"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("made"))


@query("""
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(place)::INTEGER AS first_place FROM (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) GROUP BY word""")
def words_exploded(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("place").alias("first_place"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm, list_max(embedding)::DOUBLE AS most,
  len(list_filter(embedding, lambda x: x > 0))::INTEGER AS n_positive FROM embeddings""")
def array_lambdas(spark, sf_dir):
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(squares, 6).alias("norm"), F.array_max("embedding").cast("double").alias("most"), F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"))


@query("""
SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q""")
def vector_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).select("embedding").scalar()
    return e.select("vec_id", "embedding", first.alias("first")).select("vec_id", F.round(tx.dot("embedding", "first"), 6).alias("similarity"))


@query("""
SELECT conv_id, array_to_string(list_sort(list_distinct(r)), ',') AS kinds, len(r)::INTEGER AS turns, array_to_string(r[1:3], '>') AS opening, list_contains(r, 'system') AS has_system,
  array_to_string(list_reverse(r), ',') AS backwards, list_position(r, 'assistant')::BIGINT AS first_answer, r[-1] AS last_role, array_to_string(list_sort(list_concat(list_distinct(r), ['zz'])), ',') AS more
FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)""".replace("list_position(r, 'assistant')", "coalesce(list_position(r, 'assistant'), 0)"))
def arrays(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    text = lambda a: F.array_join(a, ",")
    return turns.select(
        "conv_id", text(F.array_sort(F.array_distinct("r"))).alias("kinds"), F.size("r").alias("turns"), F.array_join(F.slice("r", 1, 3), ">").alias("opening"),
        F.array_contains("r", "system").alias("has_system"), text(F.reverse("r")).alias("backwards"), F.array_position("r", "assistant").alias("first_answer"),
        F.element_at("r", -1).alias("last_role"), text(F.array_sort(F.array_union("r", F.array(F.lit("zz"))))).alias("more"))


@query("""
SELECT n_nationkey, m['key'][1] AS by_key, array_to_string(map_keys(m), ',') AS keys, s.name AS field, s.place.region AS nested
FROM (SELECT n_nationkey, MAP {'key': [n_nationkey::VARCHAR], 'name': [n_name]} AS m, {'name': n_name, 'place': {'region': n_regionkey}} AS s FROM nation)""")
def maps_and_structs(spark, sf_dir):
    m = F.create_map(F.lit("key"), F.array(F.col("n_nationkey").cast("string")), F.lit("name"), F.array("n_name"))
    s = F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("place"))
    both = table(spark, sf_dir, "nation").select("n_nationkey", m.alias("m"), s.alias("s"))
    return both.select("n_nationkey", F.col("m")["key"][0].alias("by_key"), F.array_join(F.map_keys("m"), ",").alias("keys"), F.col("s.name").alias("field"), F.col("s.place.region").alias("nested"))
