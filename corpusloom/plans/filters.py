"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import bounded
from corpusloom.operators import verdicts as V
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


def picked(column: str, values: list | None, null_passes: bool = False) -> Column:
    """OR inside a facet; an empty pick is no filter."""
    if not values:
        return F.lit(True)
    hit = F.col(column).isin(values)
    return hit | F.col(column).isNull() if null_passes else F.coalesce(hit, F.lit(False))


def scope(**picks: list | None) -> Column:
    """AND across facets."""
    return reduce(and_, (picked(c, v) for c, v in picks.items()), F.lit(True))


@query(r"""
SELECT lang, count(*) AS n_hits, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents
WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])that the([^A-Za-z0-9_]|$)') AND n_chars >= 100 AND lang IN ('en', 'de') GROUP BY lang
""", rows="B1")
def text_search_phrase(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").where(F.col("text").rlike(bounded("that the")) & (F.col("n_chars") >= 100) & F.col("lang").isin("en", "de"))
    return hits.groupBy("lang").agg(F.count("*").alias("n_hits"), F.sum("n_chars").cast("long").alias("n_chars"))


@query("""
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id
""", rows="B2")
def benchmark_passages(spark: SparkSession, d: str) -> DataFrame:
    """Which documents hold a benchmark passage.

    A passage's first 24 characters behind white space must stand behind white
    space in the document too: an equi-join on these, then an exact test.
    Passages without such a place are looked for by their beginning, everywhere.
    """
    key = 24
    behind_blank = F.regexp_extract_all("text", F.lit(rf"(?s)(?<=[ \n])(?=(.{{{key}}}))"), F.lit(1))
    items = table(spark, d, "benchmark").where("length(text) > 0").select("item_id", F.col("text").alias("passage"), F.get(behind_blank, F.lit(0)).alias("head"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    heads = docs.select("doc_id", F.explode(F.array_distinct(behind_blank)).alias("head"))
    found = heads.join(items.where("head is not null").select("item_id", "head"), "head").select("doc_id", "item_id").distinct()
    rest = items.where("head is null").select("item_id", F.substring("passage", 1, key).alias("head"), F.least(F.lit(key), F.length("passage")).alias("n"))
    if rest.limit(1).count():
        sizes = [r["n"] for r in rest.select("n").distinct().collect()]  # at most 24
        all_heads = F.concat(*(F.expr(f"transform(sequence(1, greatest(1, length(text) - {n - 1})), i -> substring(text, i, {n}))") for n in sizes))
        slow = docs.select("doc_id", F.explode(F.array_distinct(all_heads)).alias("head")).join(rest.select("item_id", "head"), "head")
        found = found.union(slow.select("doc_id", "item_id")).distinct()
    hits = found.join(docs, "doc_id").join(items.select("item_id", "passage"), "item_id").where(F.contains("text", "passage"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""
SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0
""", rows="B3")
def taxonomy_slice(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(spark, d).where(scope(r_name=["ASIA"], c_mktsegment=["BUILDING", "MACHINERY"]) & (F.col("c_acctbal") >= 0)).select("c_custkey", "c_mktsegment", "n_name", "r_name")


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))


@query("""
SELECT c_custkey FROM (SELECT *, CASE WHEN c_acctbal < 1000 THEN NULL ELSE c_mktsegment END AS alt FROM customer JOIN nation ON c_nationkey = n_nationkey)
WHERE n_regionkey IN (1, 2, 3) AND (alt IN ('BUILDING') OR alt IS NULL) AND c_acctbal BETWEEN -500 AND 5000
""", rows="B5 B6")
def row_filter_null_alt(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy(spark, d).withColumn("alt", F.when(F.col("c_acctbal") >= 1000, F.col("c_mktsegment")))
    return rows.where(picked("n_regionkey", [1, 2, 3]) & picked("alt", ["BUILDING"], null_passes=True) & F.col("c_acctbal").between(-500, 5000)).select("c_custkey")


@query("""
SELECT c_custkey, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND (r_name <> 'ASIA' OR n_name IN (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))
""", rows="B7 B9 B10")
def taxonomy_hierarchy_filter(spark: SparkSession, d: str) -> DataFrame:
    """A picked child narrows only its own parent."""
    rows = hierarchy(spark, d)
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    child = dims.where("r_name = 'ASIA'").agg(F.min("n_name").alias("pick"))
    hit = rows.crossJoin(F.broadcast(child))  # one row
    return hit.where(F.col("r_name").isin("ASIA", "EUROPE") & ((F.col("r_name") != "ASIA") | (F.col("n_name") == F.col("pick")))).select("c_custkey", "r_name", "n_name")


@query("""
WITH t AS (SELECT r_name, n_name, CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS alt FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
     s AS (SELECT n_name FROM t GROUP BY n_name HAVING count(*) >= 30 AND count(alt) >= 0.5 * count(*))
SELECT n_name, alt, count(*) AS n FROM t JOIN s USING (n_name) WHERE alt IS NOT NULL GROUP BY n_name, alt HAVING count(*) >= 10
""", rows="B8")
def subtyped_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy(spark, d).withColumn("alt", F.when(F.col("c_acctbal") > 3000, F.col("c_mktsegment")))
    subs = rows.groupBy("n_name").agg(F.count("*").alias("n"), F.count("alt").alias("with_alt")).where("n >= 30 and with_alt >= 0.5 * n").select("n_name")
    return rows.where("alt is not null").join(subs, "n_name").groupBy("n_name", "alt").agg(F.count("*").alias("n")).where("n >= 10")


@query("""
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'error') AND CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3)
""", rows="B12")
def scope_multi_select(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.where(scope(event_type=["purchase", "error"], k=[1, 2, 3], user_id=None)).select("event_id", "user_id", "event_type")


@query("""
SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('purchase')
""", rows="B13")
def facet_options(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.where(scope(event_type=["purchase"])).select("k").distinct()


@query("""
SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 're') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')
""", rows="B14")
def token_and_search(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    tokens = F.split(F.lit("re brand#1"), r"\s+")
    return table(spark, d, "part").withColumn("hay", hay).where(F.forall(tokens, lambda t: F.contains("hay", t))).select("p_partkey")


@query("""
SELECT name, CAST(row_number() OVER (ORDER BY NOT starts_with(lower(name), 'b'), name) AS BIGINT) AS rank FROM (
  SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 'b')) QUALIFY rank <= 12
""", rows="B15 B16")
def typeahead_rank(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().where(F.contains(F.lower("name"), F.lit("b")))
    order = [~F.startswith(F.lower("name"), F.lit("b")), F.col("name")]
    top = names.orderBy(*order).limit(12)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("""
SELECT 'order without customer' AS label, CAST(count(*) AS BIGINT) AS n FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'negative balance', CAST(count(*) AS BIGINT) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'repeated line number', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'shipped before ordered', CAST(count(*) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'empty text', CAST(count(*) AS BIGINT) FROM documents WHERE text IS NULL OR length(trim(text)) = 0
""", rows="B23")
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    orders, lines = t("orders"), t("lineitem")
    rules = {
        "order without customer": orders.join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count("*").alias("n")),
        "negative balance": t("customer").where("c_acctbal < 0").agg(F.count("*").alias("n")),
        "repeated line number": lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("m")).where("m > 1").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")),
        "shipped before ordered": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").agg(F.count("*").alias("n")),
        "empty text": t("documents").where("text is null or length(trim(text)) = 0").agg(F.count("*").alias("n")),
    }
    return reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("label"), F.col("n").cast("long").alias("n")) for k, f in rules.items()))


@query("""
SELECT source, CAST(count(*) FILTER (WHERE length(text) < 120 AND regexp_matches(text, '(?i)license|copyright|all rights reserved')) AS BIGINT) AS n_boilerplate, count(*) AS n FROM documents GROUP BY source
""", rows="B19")
def boilerplate_filter(spark: SparkSession, d: str) -> DataFrame:
    hit = V.is_boilerplate(F.col("text"), "(?i)license|copyright|all rights reserved")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(hit).alias("n_boilerplate"), F.count("*").alias("n"))


GENERIC_SQL = "[" + ", ".join(f"'{g}'" for g in V.GENERIC) + "]"
PARTICLES_SQL = ", ".join(f"'{p}'" for p in V.PARTICLES)


@query(f"""
WITH f AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), a AS (SELECT *, lower(string_split(url, '/')[-1]) AS file, replace(host, '.', ' ') AS artist FROM f),
 p AS (SELECT *, list_filter(string_split_regex(trim(artist), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({PARTICLES_SQL})) || [replace(artist, ' ', '_')] AS names FROM a)
SELECT url, host, CASE WHEN len(list_filter(names, lambda x: contains(file, x))) > 0 THEN 'pass' WHEN regexp_matches(file, '^[a-z]+_[a-z]+_-_') OR contains(file, '_by_') OR len(list_filter({GENERIC_SQL}, lambda g: contains(file, g))) > 0 THEN 'fail' ELSE 'pending' END AS verdict FROM p
""", rows="B24")
def url_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The last part of each address as a file's name, its host's words as the artist's."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    file = F.element_at(F.split("url", "/"), -1)
    return table(spark, d, "pages").select("url", host.alias("host"), V.filename_verdict(file, F.replace(host, F.lit("."), F.lit(" "))).alias("verdict"))
