"""Clue reports, answer and mention matches, years, names of works and packed numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.numeric import half_float
from corpusloom.operators.match import first_by_precedence
from corpusloom.plans.registry import query
from corpusloom.sources.dsl import entry_blocks, plan
from corpusloom.sources.tables import numbered, table


def matches(rows: DataFrame, phrase: str, *, answer: str, text: str) -> DataFrame:
    """Rows whose answer holds the phrase as whole words (``kind`` answer), or else whose text does (mention)."""
    whole = X.bounded(phrase)
    kind = F.when(F.col(answer).rlike(whole), "answer").when(F.col(text).rlike(whole), "mention")
    return rows.withColumn("kind", kind).where("kind is not null")


@query(r"""
SELECT p_partkey, kind FROM (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9_])small([^A-Za-z0-9_]|$)') THEN 'answer'
 WHEN regexp_matches(p_type || ' of ' || p_brand, '(?i)(^|[^A-Za-z0-9_])small([^A-Za-z0-9_]|$)') THEN 'mention' END AS kind FROM part) WHERE kind IS NOT NULL
""", rows="B2")
def answer_matches(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("text", F.concat_ws(" of ", "p_type", "p_brand"))
    return matches(parts, "small", answer="p_name", text="text").select("p_partkey", "kind")


DATED = "text || ' In ' || CAST(1700 + doc_id % 320 AS VARCHAR) || ' and ' || CAST(1 + doc_id % 500 AS VARCHAR) || ' B.C. or ' || CAST(1 + doc_id % 7 AS VARCHAR) || ' bce, not in 3021.'"
YEARS = f"""
SELECT doc_id, source, unnest(list_distinct(list_transform(regexp_extract_all(t, '\\b(1[0-9]{{3}}|20[0-2][0-9])\\b', 1), lambda y: CAST(y AS INTEGER))
 || list_transform(regexp_extract_all(t, '(?i)\\b([0-9]{{1,4}})\\s*(?:BCE?|B\\.C\\.?)\\b', 1), lambda y: -CAST(y AS INTEGER)))) AS year FROM (SELECT doc_id, source, {DATED} AS t FROM documents WHERE text IS NOT NULL)
"""


def dated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").withColumn("t", F.expr(DATED.replace("VARCHAR", "STRING")))
    return docs.select("doc_id", "source", F.explode(X.years(F.col("t"))).alias("year"))


@query(YEARS.replace("doc_id, source, unnest", "doc_id, unnest"), rows="I5")
def years_named(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("doc_id", "year")


@query(f"WITH y AS ({YEARS}) SELECT source, year, n FROM (SELECT source, year, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, year) AS p FROM y WHERE year < 2005 GROUP BY source, year) WHERE p = 1", rows="I5")
def modal_year(spark: SparkSession, d: str) -> DataFrame:
    """The year before 2005 that most of a source's documents name; of equals the earliest."""
    counts = dated(spark, d).where("year < 2005").groupBy("source", "year").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min_by(F.struct("year", "n"), F.struct(-F.col("n"), "year")).alias("y")).select("source", "y.year", "y.n")


@query(r"""
SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(name, '\(.*?\)', '', 'g')), '\s*/\s*.*', '', 'g')), ',?\s*c\.\s*[0-9]{4}.*', '', 'g')) AS name
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || p_brand || ') / ' || p_type WHEN 1 THEN p_name || ', c. 16' || (10 + p_size) || ' or so' ELSE '(' || p_type || ') ' || p_name END AS name FROM part)
""", rows="H25")
def work_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.expr("p_name || ' (' || p_brand || ') / ' || p_type")).when(kind == 1, F.expr("p_name || ', c. 16' || (10 + p_size) || ' or so'")).otherwise(F.expr("'(' || p_type || ') ' || p_name"))
    return table(spark, d, "part").select("p_partkey", X.clean_work_name(name).alias("name"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919 + l_linenumber) % 65536 AS h FROM lineitem), p AS (SELECT *, h >> 15 & 1 AS s, h >> 10 & 31 AS e, h & 1023 AS f FROM b)
SELECT l_orderkey, l_linenumber, (CASE WHEN s = 1 THEN -1 ELSE 1 END) * (CASE WHEN e = 0 THEN f * pow(2.0::DOUBLE, -24) ELSE (1 + f / 1024::DOUBLE) * pow(2.0::DOUBLE, e - 15) END) AS value FROM p WHERE e < 31
""", rows="I1")
def half_floats(spark: SparkSession, d: str) -> DataFrame:
    """Packed half-precision numbers; infinities and what isn't a number are left out."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 7919 + F.col("l_linenumber")) % 65536).cast("int").alias("h"))
    value = half_float(F.col("h"))
    return rows.select("l_orderkey", "l_linenumber", value.alias("value")).where(~F.isnan("value") & (F.abs("value") < float("inf")))


@query("""
WITH c AS (SELECT conv_id, turn, '  - ' || coalesce(text, '') || CASE WHEN role = 'user' THEN ' [ASK]' ELSE '' END AS line FROM conversations WHERE conv_id IS NOT NULL), n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS number FROM c GROUP BY conv_id)
SELECT conv_id, number, '[T' || number || '] ' || count(*) || ' lines' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) AS report FROM c JOIN n USING (conv_id) GROUP BY conv_id, number
""", rows="A37")
def clue_report(spark: SparkSession, d: str) -> DataFrame:
    """A text block for each conversation, numbered, with a tagged line for each turn."""
    tag = F.when(F.col("role") == "user", " [ASK]").otherwise("")
    lines = table(spark, d, "conversations").where("conv_id is not null").select("conv_id", "turn", F.concat(F.lit("  - "), F.coalesce("text", F.lit("")), tag).alias("line"))
    blocks = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    placed = numbered(blocks, ["conv_id"], "place", F.floor(F.col("conv_id") / 4096)).withColumn("number", (F.col("place") + 1).cast("long"))
    head = F.concat(F.lit("[T"), F.col("number").cast("string"), F.lit("] "), F.size("lines").cast("string"), F.lit(" lines"))
    return placed.select("conv_id", "number", F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("report"))


OUTLINE = """SELECT p_brand AS unit, p_partkey * 8 + k - 1 AS pos, line FROM (SELECT p_brand, p_partkey, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM (
 SELECT p_brand, p_partkey, [CASE WHEN p_size % 7 = 0 THEN '##' ELSE '# ' || p_type END, '> first', CASE WHEN p_size % 3 = 0 THEN '' ELSE '>> of ' || p_name END, CASE WHEN p_size % 5 = 0 THEN '- ' ELSE '' END || p_name, ' - nested of ' || p_size, p_type] AS lines FROM part))"""
SECTIONS = f"""o AS ({OUTLINE}), k AS (SELECT *, trim(line) AS l, CASE WHEN trim(line) LIKE '#%' THEN 'heading' WHEN trim(line) LIKE '>%' THEN 'blurb' ELSE 'entry' END AS kind FROM o),
 n AS (SELECT *, count(*) FILTER (WHERE kind = 'heading') OVER (PARTITION BY unit ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM k)"""


def outline(spark: SparkSession, d: str) -> DataFrame:
    """An outline made of parts: a heading, blurbs, an entry, a nested line and another entry for each."""
    lines = F.array(
        F.when(F.col("p_size") % 7 == 0, "##").otherwise(F.concat(F.lit("# "), "p_type")), F.lit("> first"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(">> of "), "p_name")),
        F.concat(F.when(F.col("p_size") % 5 == 0, "- ").otherwise(""), "p_name"), F.concat(F.lit(" - nested of "), F.col("p_size").cast("string")), F.col("p_type"),
    )
    return table(spark, d, "part").select(F.col("p_brand").alias("unit"), "p_partkey", F.posexplode(lines).alias("k", "line")).select("unit", (F.col("p_partkey") * 8 + F.col("k")).alias("pos"), "line")


@query(f"WITH {SECTIONS} SELECT unit, section, max(trim(regexp_replace(l, '^#+', ''))) FILTER (WHERE kind = 'heading') AS name, coalesce(trim(regexp_replace(arg_max(l, pos) FILTER (WHERE kind = 'blurb'), '^>+', '')), '') AS blurb FROM n WHERE section > 0 GROUP BY ALL HAVING name <> ''", rows="A28")
def plan_sections(spark: SparkSession, d: str) -> DataFrame:
    return plan(outline(spark, d), key="unit", pos="pos", text="line")


@query(f"""
WITH {SECTIONS}, e AS (SELECT *, row_number() OVER w = 1 OR NOT starts_with(l, '- ') AS opens FROM n WHERE section > 0 AND kind = 'entry' AND l <> '' WINDOW w AS (PARTITION BY unit, section ORDER BY pos)),
 b AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY unit, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM e)
SELECT unit, section, block, min(pos) AS pos, CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS block_text FROM b GROUP BY ALL
""", rows="A28")
def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    return entry_blocks(outline(spark, d), key="unit", pos="pos", text="line")


@query("""
SELECT p_partkey, CASE WHEN p_retailprice > 1500 AND p_size > 25 THEN 'slug ' || p_partkey WHEN p_type <> 'SMALL' THEN 'subcategory ' || p_type WHEN p_brand <> 'Brand#2' THEN 'category ' || p_brand END AS config FROM part
""", rows="K3")
def category_config(spark: SparkSession, d: str) -> DataFrame:
    """The configuration of a unit: its own, else its subcategory's, else its category's, else none."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice", "p_size")
    own = part.where("p_retailprice > 1500 and p_size > 25").select("p_partkey", F.concat(F.lit("slug "), F.col("p_partkey").cast("string")).alias("target"))
    layer = lambda c, but, name: part.select(c).distinct().where(F.col(c) != but).select(c, F.concat(F.lit(f"{name} "), c).alias("target"))
    found = first_by_precedence(part, [(own, ["p_partkey"]), (layer("p_type", "SMALL", "subcategory"), ["p_type"]), (layer("p_brand", "Brand#2", "category"), ["p_brand"])])
    return found.select("p_partkey", F.col("target").alias("config"))


@query(None, rows="H15")
def linked_text(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts linked in a made-up text: (p_partkey, html)."""
    names = F.array(F.col("p_name"), F.col("p_type"), F.concat_ws(" ", "p_name", "p_type"))
    text = F.concat_ws(" ", F.lit("A <i title='red'>"), "p_name", F.lit("</i> and"), "p_name", "p_type", F.lit("or"), "p_type")
    return table(spark, d, "part").select("p_partkey", X.linked_udf(text, names).alias("html"))
