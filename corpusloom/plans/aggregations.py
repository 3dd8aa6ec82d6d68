"""Frequencies, coverage, breakdowns, facets, shares and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ascii_key, content_words, content_words_sql
from corpusloom.operators import cluster as C
from corpusloom.operators.ordered import attempts
from corpusloom.plans.filters import hierarchy
from corpusloom.plans.joins import P_KEY, TIER_CTE, answer_rows, tier_tables
from corpusloom.operators.match import tiered
from corpusloom.operators import verdicts as V
from corpusloom.plans.registry import query
from corpusloom.sources.tables import numbered, table

LOG = """log AS (SELECT event_id, ts, user_id AS uid, event_type, CASE event_type WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'W' ELSE 'D' END AS res,
 least(value / 500, 1.0) AS bf, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
CURATED, APPENDIX = 3, 2


def frequency(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("freq"))


def tier(freq: str):
    return F.when(F.col(freq) >= CURATED, "curated").when(F.col(freq) >= APPENDIX, "appendix")


@query(f"SELECT key, count(*) AS freq, min(p_name) AS answer FROM (SELECT {P_KEY} AS key, p_name FROM part WHERE p_size BETWEEN 5 AND 40) GROUP BY key ORDER BY freq DESC, key LIMIT 5000", rows="D1")
def freq_list(spark: SparkSession, d: str) -> DataFrame:
    """Answers by count; the limit is the report's length."""
    rows = table(spark, d, "part").where("p_size between 5 and 40").select(ascii_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key"), "p_name")
    return rows.groupBy("key").agg(F.count("*").alias("freq"), F.min("p_name").alias("answer")).orderBy(F.desc("freq"), "key").limit(5000)


@query(TIER_CTE + """
, f AS (SELECT key, count(*) AS freq, min(category) AS category FROM a GROUP BY key HAVING count(*) >= 2)
SELECT key, freq, CASE WHEN freq >= 3 THEN 'curated' ELSE 'appendix' END AS tier,
  CASE WHEN o.key IS NOT NULL THEN 'override' WHEN e.key IS NOT NULL THEN 'exact' WHEN al.key IS NOT NULL AND (f.category IS NULL OR al.category IS NULL OR f.category = al.category) THEN 'alias' ELSE 'unmatched' END AS status
FROM f LEFT JOIN o USING (key) LEFT JOIN e USING (key) LEFT JOIN al USING (key)
""", rows="D2")
def freq_tiered(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_rows(spark, d)
    freq = rows.groupBy("key").agg(F.count("*").alias("freq"), F.min("category").alias("category")).where(F.col("freq") >= APPENDIX)
    return tiered(freq, *tier_tables(rows)).select("key", "freq", tier("freq").alias("tier"), "status")


@query(TIER_CTE + """
, f AS (SELECT key, count(*) AS freq FROM a GROUP BY key HAVING count(*) >= 3)
SELECT key, freq, key LIKE '%large%' AS is_place FROM f WHERE key NOT IN (SELECT key FROM o) AND key NOT IN (SELECT key FROM e) AND key NOT IN (SELECT key FROM al)
""", rows="D3")
def freq_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_rows(spark, d)
    freq = frequency(rows, "key").where("freq >= 3")
    for known in tier_tables(rows):
        freq = freq.join(known.select("key"), "key", "left_anti")
    return freq.select("key", "freq", F.contains("key", F.lit("large")).alias("is_place"))


@query(f"""
WITH f AS (SELECT split_part(p_type, ' ', 1) AS unit, {P_KEY} AS key, count(*) AS freq FROM part GROUP BY ALL)
SELECT coalesce(unit, 'TOTAL') AS unit, count(*) AS n, CAST(count(*) FILTER (WHERE freq >= 2) AS BIGINT) AS at_2, CAST(count(*) FILTER (WHERE freq >= 3) AS BIGINT) AS at_3 FROM f GROUP BY ROLLUP (unit)
""", rows="D4")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = answer_rows(spark, d).groupBy(F.col("category").alias("unit"), "key").agg(F.count("*").alias("freq"))
    out = f.rollup("unit").agg(F.count("*").alias("n"), F.count_if(F.col("freq") >= 2).alias("at_2"), F.count_if(F.col("freq") >= 3).alias("at_3"))
    return out.withColumn("unit", F.coalesce("unit", F.lit("TOTAL")))


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first_id FROM customer GROUP BY ALL)
SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n, arg_max(c_mktsegment, (n, -first_id)) AS modal FROM g GROUP BY c_nationkey
""", rows="D5")
def modal_group(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))
    return g.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.max_by("c_mktsegment", F.struct(F.col("n"), -F.col("first_id"))).alias("modal"))


@query("""
SELECT c_mktsegment, count(*) AS total, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS linked, round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS share
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY c_mktsegment
""", rows="C19 D6")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("m"))
    linked = F.count_if(F.col("m") > 0)
    return table(spark, d, "customer").join(made, "c_custkey", "left").groupBy("c_mktsegment").agg(
        F.count("*").alias("total"), linked.alias("linked"), F.round(linked / F.count("*"), 6).alias("share")
    )


@query(None, rows="D8")
def cluster_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each conversation, clustered by the content words they share."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", content_words(F.coalesce("text", F.lit(""))).alias("words"))
    return C.cluster_rows(turns, key="conv_id", id_col="turn", words_col="words")


WORDS_SQL = "SELECT DISTINCT item_id, unnest(" + content_words_sql("text") + ") AS w FROM benchmark"


@query(f"""
WITH x AS ({WORDS_SQL}), n AS (SELECT count(*) AS n FROM benchmark), df AS (SELECT w, 1.0 / (1.0 + 10.0 * count(*) / any_value(n)) AS g FROM x, n GROUP BY w),
  t AS (SELECT item_id, sum(g) AS total FROM x JOIN df USING (w) GROUP BY 1), s AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared, sum(g) AS both_ FROM x a JOIN x b USING (w) JOIN df USING (w) WHERE a.item_id < b.item_id GROUP BY ALL)
SELECT a, b, shared, round(both_ / least(p.total, q.total), 6) AS score FROM s JOIN t p ON a = p.item_id JOIN t q ON b = q.item_id WHERE shared >= 2 AND round(both_ / least(p.total, q.total), 6) >= 0.3
""", rows="D9")
def pair_containment(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    x = items.select("item_id", F.explode(content_words(F.col("text"))).alias("w"))
    n = items.agg(F.count("*").alias("n"))
    df = x.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("w", (1 / (1 + 10 * F.col("df") / F.col("n"))).alias("g"))
    xw = x.join(df, "w")
    total = xw.groupBy("item_id").agg(F.sum("g").alias("total"))
    pair = xw.withColumnRenamed("item_id", "a").join(x.withColumnRenamed("item_id", "b"), "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("g").alias("both_"))
    out = pair.join(total.toDF("a", "ta"), "a").join(total.toDF("b", "tb"), "b")
    return out.withColumn("score", F.round(F.col("both_") / F.least("ta", "tb"), 6)).where("shared >= 2 and score >= 0.3").select("a", "b", "shared", "score")


@query(f"""
WITH {LOG}
SELECT event_type, k, grouping(event_type) AS all_types, grouping(k) AS all_k, count(*) AS n, round(avg(CASE WHEN res = 'C' THEN 1.0 ELSE 0.0 END), 6) AS acc,
 round(avg(CASE WHEN res = 'C' THEN 1 - bf END), 6) AS celerity FROM log WHERE k IS NOT NULL GROUP BY CUBE (event_type, k)
""", rows="D12 D13 D21")
def breakdown_cube(spark: SparkSession, d: str) -> DataFrame:
    log = attempts(table(spark, d, "events")).where("k is not null")
    right = F.col("res") == "C"
    return log.cube("event_type", "k").agg(
        F.grouping("event_type").cast("long").alias("all_types"), F.grouping("k").cast("long").alias("all_k"), F.count("*").alias("n"),
        F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 6).alias("acc"), F.round(F.avg(F.when(right, 1 - F.col("bf"))), 6).alias("celerity"),
    )


@query(f"""
WITH {LOG}
SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM log WHERE k IN (1, 2, 3) GROUP BY event_type
UNION ALL SELECT 'k', CAST(k AS VARCHAR), count(*) FROM log WHERE event_type IN ('purchase', 'view') GROUP BY k
""", rows="D14")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each facet under the other facets' picks, in one pass over the log."""
    log = attempts(table(spark, d, "events"))
    by_k, by_type = F.col("k").isin(1, 2, 3), F.col("event_type").isin("purchase", "view")
    entries = F.array(
        F.struct(F.lit("event_type").alias("facet"), F.col("event_type").alias("value"), by_k.alias("ok")),
        F.struct(F.lit("k").alias("facet"), F.col("k").cast("string").alias("value"), by_type.alias("ok")),
    )
    return log.select(F.explode(entries).alias("e")).where("e.ok").groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 3 OR c_nationkey = 0", rows="D15")
def group_facet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).where("n >= 3 or c_nationkey = 0")


@query(f"""
WITH {LOG}, r AS (SELECT uid, res, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, event_id DESC) AS p, count(*) OVER (PARTITION BY uid) AS n FROM log)
SELECT uid, CAST(least(50, n // 2) AS BIGINT) AS width, round(avg(CASE WHEN p <= least(50, n // 2) THEN CASE WHEN res = 'C' THEN 1.0 ELSE 0.0 END END), 6) AS last_acc,
 round(avg(CASE WHEN p > least(50, n // 2) AND p <= 2 * least(50, n // 2) THEN CASE WHEN res = 'C' THEN 1.0 ELSE 0.0 END END), 6) AS prior_acc FROM r WHERE n >= 20 GROUP BY uid, n
""", rows="D16")
def trend_delta(spark: SparkSession, d: str) -> DataFrame:
    log = attempts(table(spark, d, "events"))
    w = Window.partitionBy("uid")
    r = log.withColumn("p", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).withColumn("n", F.count("*").over(w)).where("n >= 20")
    r = r.withColumn("width", F.least(F.lit(50), F.floor(F.col("n") / 2)).cast("long")).withColumn("ok", F.when(F.col("res") == "C", 1.0).otherwise(0.0))
    return r.groupBy("uid", "width").agg(
        F.round(F.avg(F.when(F.col("p") <= F.col("width"), F.col("ok"))), 6).alias("last_acc"),
        F.round(F.avg(F.when((F.col("p") > F.col("width")) & (F.col("p") <= 2 * F.col("width")), F.col("ok"))), 6).alias("prior_acc"),
    )


@query(f"WITH {LOG} SELECT uid, count(DISTINCT k) AS n_keys, count(DISTINCT event_type) AS n_types, count(*) AS n FROM log GROUP BY uid", rows="D17")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    return attempts(table(spark, d, "events")).groupBy("uid").agg(F.count_distinct("k").alias("n_keys"), F.count_distinct("event_type").alias("n_types"), F.count("*").alias("n"))


@query(f"""
WITH {LOG} SELECT CAST(least(floor(bf * 12), 11) AS BIGINT) AS bin, count(*) AS n, CAST(count(*) FILTER (WHERE res = 'C') AS BIGINT) AS n_right, round(avg(bf), 6) AS mean_bf FROM log GROUP BY bin HAVING count(*) >= 3
""", rows="D18")
def calibration_bands(spark: SparkSession, d: str) -> DataFrame:
    log = attempts(table(spark, d, "events"))
    return log.groupBy(F.least(F.floor(F.col("bf") * 12), F.lit(11)).cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col("res") == "C").alias("n_right"), F.round(F.avg("bf"), 6).alias("mean_bf")
    ).where("n >= 3")


@query(None, rows="D18")
def calibration_fit(spark: SparkSession, d: str) -> DataFrame:
    log = attempts(table(spark, d, "events")).withColumn("right", (F.col("res") == "C").cast("double"))
    return C.calibration(log, key="uid", x_col="bf", y_col="right")


@query(None, rows="D19 D20")
def strength_effects(spark: SparkSession, d: str) -> DataFrame:
    """How sections differ in their share of right answers, adjusted for level and time; both are taken from the item's number."""
    log = attempts(table(spark, d, "events")).withColumn("y", (F.col("res") == "C").cast("double"))
    log = log.select("ts", "event_id", "y", F.pmod("k", F.lit(12)).cast("string").alias("section"), F.pmod(F.floor(F.col("k") / 12), F.lit(5)).alias("level"))
    placed = numbered(log, ["ts", "event_id"], "place")
    n = log.agg(F.count("*").alias("rows"))
    return C.strength(placed.crossJoin(F.broadcast(n)), group="section", level="level", y="y", place="place", rows="rows")


VOTES = """
WITH v AS (SELECT doc_id, s, CAST(sum(w) AS DOUBLE) AS score FROM (
  SELECT doc_id, 'en' AS s, 4.0 AS w FROM documents WHERE contains(lower(text), ' the ') UNION ALL SELECT doc_id, 'de', 4.0 FROM documents WHERE contains(lower(text), ' und ')
  UNION ALL SELECT doc_id, 'fr', 4.0 FROM documents WHERE contains(lower(text), ' le ') UNION ALL SELECT doc_id, 'es', 4.0 FROM documents WHERE contains(lower(text), ' el ') UNION ALL SELECT doc_id, lang, 5.0 FROM documents WHERE n_chars >= 200) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s) AS p, lead(score, 1, 0.0) OVER (PARTITION BY doc_id ORDER BY score DESC, s) AS second FROM v)
SELECT doc_id, s AS section, score FROM r WHERE p = 1 AND score >= 3.0 AND score >= 1.5 * second
"""


@query(VOTES, rows="D25 D26 D27")
def section_vote(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    low = F.lower("text")
    words = {"en": " the ", "de": " und ", "fr": " le ", "es": " el "}
    votes = F.array_compact(F.array(
        *(F.when(F.contains(low, F.lit(w)), F.struct(F.lit(s).alias("s"), F.lit(4.0).alias("w"))) for s, w in words.items()),
        F.when(F.col("n_chars") >= 200, F.struct(F.col("lang").alias("s"), F.lit(5.0).alias("w"))),
    ))
    cast = docs.select("doc_id", F.explode(votes).alias("v")).select("doc_id", F.col("v.s").alias("section"), F.col("v.w").alias("weight"))
    return V.voted(cast, key="doc_id", choice="section", weight="weight")


@query("""
SELECT l_orderkey, count(*) AS n_works, round(sum(coalesce(l_quantity, 1)), 4) AS clues, round(count(*) / sum(coalesce(l_quantity, 1)) * 100, 4) AS ratio FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 3
""", rows="D28")
def nested_agg_ratio(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity")).alias("works"))  # lines of one order
    clues = F.aggregate("works", F.lit(0.0), lambda s, w: s + F.coalesce(w["l_quantity"], F.lit(1.0)))
    out = g.select("l_orderkey", F.size("works").cast("long").alias("n_works"), clues.alias("c")).where("n_works <= 3")
    return out.select("l_orderkey", "n_works", F.round("c", 4).alias("clues"), F.round(F.col("n_works") / F.col("c") * 100, 4).alias("ratio"))


@query("""
WITH t AS (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
 w AS (SELECT r_name, n_name, n, CASE r_name WHEN 'ASIA' THEN 3.0 WHEN 'EUROPE' THEN 1.0 WHEN 'AFRICA' THEN 0.0 ELSE 2.0 END AS wr, CAST(1 + length(n_name) % 3 AS DOUBLE) AS wn FROM t),
 g AS (SELECT sum(wr) AS s FROM (SELECT DISTINCT r_name, wr FROM w))
SELECT r_name, n_name, round(wr / s * wn / sum(wn) OVER (PARTITION BY r_name) / n, 9) AS weight FROM w, g WHERE wr > 0
""", rows="D31")
def dist_weights(spark: SparkSession, d: str) -> DataFrame:
    """Nested shares: a parent's share, times a child's share of it, spread over the child's rows; zero excludes."""
    t = hierarchy(spark, d).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))
    wr = F.when(F.col("r_name") == "ASIA", 3.0).when(F.col("r_name") == "EUROPE", 1.0).when(F.col("r_name") == "AFRICA", 0.0).otherwise(2.0)
    w = t.withColumn("wr", wr).withColumn("wn", (1 + F.length("n_name") % 3).cast("double"))
    total = w.select("r_name", "wr").distinct().agg(F.sum("wr").alias("s"))
    share = F.col("wr") / F.col("s") * F.col("wn") / F.sum("wn").over(Window.partitionBy("r_name")) / F.col("n")
    return w.crossJoin(F.broadcast(total)).withColumn("weight", F.round(share, 9)).where("wr > 0").select("r_name", "n_name", "weight")


@query(f"""
WITH {LOG}, g AS (SELECT avg(CASE WHEN res = 'C' THEN 1.0 ELSE 0.0 END) AS w0 FROM log)
SELECT k, count(*) AS n, round((sum(CASE WHEN res = 'C' THEN 1.0 ELSE 0.0 END) + 5 * any_value(w0)) / (count(*) + 5), 6) AS mean FROM log, g GROUP BY k
""", rows="D32")
def shrunk_means(spark: SparkSession, d: str) -> DataFrame:
    log = attempts(table(spark, d, "events")).withColumn("ok", F.when(F.col("res") == "C", 1.0).otherwise(0.0))
    g = log.agg(F.avg("ok").alias("w0"))
    return log.groupBy("k").agg(F.count("*").alias("n"), F.sum("ok").alias("s")).crossJoin(F.broadcast(g)).select("k", "n", F.round((F.col("s") + 5 * F.col("w0")) / (F.col("n") + 5), 6).alias("mean"))


@query("""
SELECT coalesce(r_name, 'ALL') AS continent, coalesce(n_name, 'ALL') AS country, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""", rows="D34")
def location_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy(spark, d).rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return out.select(F.coalesce("r_name", F.lit("ALL")).alias("continent"), F.coalesce("n_name", F.lit("ALL")).alias("country"), "n", "total")


@query("SELECT md5(trim(text)) AS content, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1", rows="D30")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5(F.trim("text").cast("binary")).alias("content")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query(f"""
SELECT key, max_by(p_name, (p_retailprice, p_partkey)) AS best, count(*) AS n FROM (SELECT {P_KEY} AS key, p_name, p_retailprice, p_partkey FROM part) GROUP BY key HAVING count(*) > 1
""", rows="D36")
def normal_form_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("key", ascii_key(F.concat_ws(" ", "p_name", "p_brand")))
    return rows.groupBy("key").agg(F.max_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("best"), F.count("*").alias("n")).where("n > 1")


@query("""
SELECT lang, source, count(*) AS n, CAST(count(quality) AS BIGINT) AS sectioned, CASE WHEN count(quality) = count(*) THEN 'authored' WHEN count(quality) > 0 THEN 'draft' ELSE 'pending' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source
""", rows="D37")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    g = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("quality").alias("sectioned"))
    return g.withColumn("state", F.when(F.col("sectioned") == F.col("n"), "authored").when(F.col("sectioned") > 0, "draft").otherwise("pending"))
