"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.answers import judge_udf
from corpusloom.functions.speech import clean_udf
from corpusloom.functions.numeric import clamp, points, sigmoid
from corpusloom.plans.joins import KEY_SQL
from corpusloom.operators import clues as Q
from corpusloom.plans.registry import query
from corpusloom.sources.tables import spread, table


@query(f"SELECT p_partkey, {KEY_SQL.format('p_name')} AS key, {KEY_SQL.format('p_type')} AS type_key FROM part", rows="H1")
def key_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.key("p_name").alias("key"), X.key("p_type").alias("type_key"))


@query(f"SELECT c_custkey, {KEY_SQL.format('c_name')} AS key, {KEY_SQL.format('c_mktsegment')} AS segment_key FROM customer", rows="H1")
def key_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", X.ascii_key(F.col("c_name")).alias("key"), X.ascii_key(F.col("c_mktsegment")).alias("segment_key"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM supplier", rows="H3")
def drill_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", X.answer_drill_key("s_name").alias("key"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || ' (x) [y]', '<[^>]*>', '', 'g'), '\[[\s\S]*', ''), '\([^)]*\)', '', 'g'), '[ \t\r\n]+', ' ', 'g'), '^[ ;,]+|[ ;,]+$', '', 'g') AS display FROM pages
""", rows="H2")
def display_clean(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages as if they were answer lines."""
    return table(spark, d, "pages").select("page_id", X.clean_answerline(F.concat("html", F.lit(" (x) [y]"))).alias("display"))


@query(r"""
SELECT page_id, coalesce(list_filter(list_transform(regexp_extract_all(h, '(?is)<u>(.*?)</u>', 1), lambda x: trim(x)), lambda x: x <> '')[1], list_filter(list_transform(regexp_extract_all(h, '(?is)<b>(.*?)</b>', 1), lambda x: trim(x)), lambda x: x <> '')[1],
 trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '[\[(][\s\S]*', ''))) AS core FROM (SELECT page_id, html || ' [or <u> </u>]' AS h FROM pages)
""", rows="H4")
def answer_core(spark: SparkSession, d: str) -> DataFrame:
    """The core of whole pages: their first bold words, or their text."""
    return table(spark, d, "pages").select("page_id", X.answer_core(F.concat("html", F.lit(" [or <u> </u>]"))).alias("core"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part", rows="H6")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_type"), "_").alias("slug"))


@query(None, rows="H7 H10")
def clue_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", F.posexplode(X.sentences_udf("text")).alias("pos", "sentence"))
    return rows.where(F.length("sentence") >= 15)


@query(None, rows="H10")
def clue_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document as clues; its first 300 characters are taken as the bold, earlier part."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source"), "doc_id")
    html = F.concat(F.lit("<b>"), F.substring("text", 1, 300), F.lit("</b> (*) "), F.substring("text", 301, 1 << 30))
    clues = Q.tossup_clues(docs.select("doc_id", "text", "source", html.alias("html")), id_col="doc_id", text_col="text", html_col="html", carry=("source",))
    return clues.select("doc_id", "pos", F.length("text").alias("n_chars"), "in_power", "is_giveaway", "source")


@query("""
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS part_index, parts[i] AS text, answers[i] AS part_answer, p_name AS leadin
FROM (SELECT p_partkey, p_name, string_split(p_type, ' ') AS parts, [p_brand, CAST(p_size AS VARCHAR)] AS answers FROM part), range(1, 3) r(i) WHERE i <= least(len(parts), len(answers))
""", rows="H10 I9")
def bonus_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_type", " ").alias("parts"), F.array("p_brand", F.col("p_size").cast("string")).alias("answers"))
    return Q.bonus_clues(rows, id_col="p_partkey", leadin_col="p_name", parts_col="parts", answers_col="answers")


MARKED = "'<b>' || substr(text, 1, 60) || '<i>' || substr(text, 61, 60) || '</i></b> (*) ' || substr(text, 121, 200) || '<b>' || substr(text, 321, 40) || '</b>' || substr(text, 361)"


@query(f"""
WITH h AS (SELECT doc_id, text, {MARKED} AS html FROM documents WHERE text IS NOT NULL),
 b AS (SELECT *, array_to_string(list_transform(regexp_extract_all(html, '(?s)<b>(.*?)</b>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), ' ') AS bold FROM h)
SELECT doc_id, contains(bold, substr(text, 1, 40)) AS starts_bold, contains(bold, substr(text, 101, 40)) AS later_bold, regexp_matches(text, '(?i)for (?:10|ten) points') AS giveaway, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_chars FROM b
""", rows="H11")
def markup_tests(spark: SparkSession, d: str) -> DataFrame:
    sub = lambda a, n: F.substring("text", a, n)
    html = F.concat(F.lit("<b>"), sub(1, 60), F.lit("<i>"), sub(61, 60), F.lit("</i></b> (*) "), sub(121, 200), F.lit("<b>"), sub(321, 40), F.lit("</b>"), sub(361, 1 << 30))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", html.alias("html"))
    h = F.col("html")
    return rows.select(
        "doc_id", X.in_power(F.col("text"), h).alias("starts_bold"), X.in_power(sub(101, 40), h).alias("later_bold"),
        X.is_giveaway(F.col("text")).alias("giveaway"), F.length(X.without_tags(h)).cast("long").alias("n_chars"),
    )


ANSWER = "'<b><u>' || p_name || '</u></b> (' || p_brand || ') [or ' || p_type || '; accept the ' || p_brand || ', ' || p_name || '; do not accept ' || p_size || '; prompt on ' || p_type || ']'"


@query(f"""
WITH a AS (SELECT p_partkey, regexp_replace({ANSWER}, '<[^>]+>', '', 'g') AS line FROM part),
 s AS (SELECT p_partkey, [string_split(line, '[')[1]] || list_transform(list_filter(list_transform(string_split_regex(regexp_extract(line, '\\[([^\\]]*)\\]', 1), '[;,]| or '), lambda x: trim(x)),
   lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:do not|reject|antiprompt|prompt)\\b')), lambda x: regexp_replace(x, '(?i)^(?:or|accept|and|also accept)\\s+', '')) AS names FROM a),
 k AS (SELECT p_partkey, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM s),
 n AS (SELECT p_partkey, pos, regexp_replace(trim(regexp_replace(lower(regexp_replace(name, '\\([^)]*\\)', ' ', 'g')), '[^a-z0-9_]+', ' ', 'g')), '^(?:the|an|a) +', '') AS key FROM k),
 f AS (SELECT p_partkey, key, min(pos) AS pos FROM n WHERE key <> '' GROUP BY ALL)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS INTEGER) AS place, key FROM f
""", rows="H5")
def alternative_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of an answer line that is made up from a part: its name, and the alternatives that are accepted."""
    return Q.alternative_keys(table(spark, d, "part").select("p_partkey", F.expr(ANSWER).alias("line")), id_col="p_partkey", answer_col="line")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n, CAST(list_sum(list_transform(parts, lambda x: length(x))) AS BIGINT) AS n_chars FROM s
""", rows="H8")
def simple_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", X.simple_sentences(F.col("text")).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n"), F.when(F.size("parts") > 0, total).alias("n_chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(len(CAST(json_keys(props) AS VARCHAR[])) AS BIGINT) AS n_keys FROM events", rows="I7")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS q, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(least(coalesce(len(q), 0), coalesce(len(a), 0)) AS BIGINT) AS n_pairs FROM c
""", rows="I9")
def zip_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Length of the truncating zip of both roles' turns; counts alone, so no conversation is gathered."""
    n = lambda r: F.count_if(F.col("role") == r)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.least(n("user"), n("assistant")).alias("n_pairs"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\PL]|[^\x00-\x7F\P{Nd}]', '_', 'g') AS t FROM documents WHERE text IS NOT NULL),
 y AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\b(1[0-9]{3}|20[0-2][0-9])\b', 1), lambda v: CAST(v AS INTEGER)) || list_transform(regexp_extract_all(t, '(?i)\b([0-9]{1,4})[\s\x0B]*(?:BCE?|B\.C\.?)\b', 1), lambda v: -CAST(v AS INTEGER)) AS y FROM t)
SELECT doc_id, array_to_string(list_filter(y, lambda x, i: list_position(y, x) = i), ',') AS years FROM y WHERE len(y) > 0
""", rows="I5")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    """Years that a text names, 1000 to 2029 and BC ones, as whole words in letters of any alphabet."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", X.years(F.col("text")).alias("y"))
    return rows.where(F.size("y") > 0).select("doc_id", F.array_join("y", ",").alias("years"))


@query("""
SELECT event_id, CAST(CASE WHEN event_type = 'purchase' AND value < 250 THEN 15 WHEN event_type = 'purchase' THEN 10 WHEN event_type = 'error' THEN -5 ELSE 0 END AS INTEGER) AS points,
 round(1 / (1 + exp(-(value - 250) / 100)), 6) AS p, round(least(greatest(value / 500, 0.1), 0.9), 6) AS depth FROM events
""", rows="I3 I4")
def scoring(spark: SparkSession, d: str) -> DataFrame:
    res = F.when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "error", "W").otherwise("D")
    return table(spark, d, "events").select(
        "event_id", points(res, F.col("value") < 250).cast("int").alias("points"), F.round(sigmoid((F.col("value") - 250) / 100), 6).alias("p"), F.round(clamp(F.col("value") / 500, 0.1, 0.9), 6).alias("depth")
    )


@query(None, rows="H13 H14")
def speech_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean_udf("text").alias("spoken"))


@query(None, rows="H17 H18 H19 H20 H21 H23")
def answer_judge(spark: SparkSession, d: str) -> DataFrame:
    """Part names as answers: the first word given for the whole underlined name."""
    part = table(spark, d, "part")
    line = F.concat(F.lit("<b><u>"), F.col("p_name"), F.lit("</u></b> [accept "), F.col("p_brand"), F.lit("; prompt on "), F.substring_index("p_name", " ", 1), F.lit("]"))
    given = F.when(F.col("p_size") < 20, F.col("p_name")).when(F.col("p_size") < 35, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_type"))
    asks = spread(part.select("p_partkey", line.alias("line"), given.alias("given")), "line", "given")
    return asks.select("p_partkey", judge_udf("line", "given").alias("j")).select("p_partkey", "j.directive", "j.prompt")
