"""Joins: lookups, tiers, precedence, graphs, fuzzy and as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.numeric import dot, norm
from corpusloom.functions.text import ascii_key
from corpusloom.operators import match as M
from corpusloom.operators.ordered import as_of
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

KEY_SQL = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g')), '^(the|an|a) +', '')"
P_KEY = KEY_SQL.format("p_name || ' ' || p_brand")


def answer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as answers: key, category (type's first word) and id."""
    return table(spark, d, "part").select(
        "p_partkey", ascii_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key"), F.substring_index("p_type", " ", 1).alias("category"), "p_brand", "p_size"
    )


def tier_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overrides, exact keys and aliases made of the answers: brand 11 is overridden, large sizes are aliases."""
    overrides = rows.where("p_brand like '%1'").groupBy("key").agg(F.when(F.max("p_size") >= 25, F.max("p_brand")).alias("slug"))
    exact = rows.where("p_size < 20").groupBy("key").agg(F.concat(F.lit("t"), F.min("p_partkey").cast("string")).alias("slug"))
    alias = rows.where("p_size >= 20").select("key", F.lower("p_brand").alias("slug"), "category")
    one = M.unique_alias(alias.select("key", "slug"), exact)
    return overrides, exact, one.join(alias.groupBy("key").agg(F.min("category").alias("category")), "key")


TIER_CTE = f"""
WITH a AS (SELECT p_partkey, {P_KEY} AS key, split_part(p_type, ' ', 1) AS category, p_brand, p_size FROM part),
     o AS (SELECT key, CASE WHEN max(p_size) >= 25 THEN max(p_brand) END AS slug FROM a WHERE p_brand LIKE '%1' GROUP BY key),
     e AS (SELECT key, 't' || CAST(min(p_partkey) AS VARCHAR) AS slug FROM a WHERE p_size < 20 GROUP BY key),
     al AS (SELECT key, min(lower(p_brand)) AS slug, min(category) AS category FROM a WHERE p_size >= 20 AND key NOT IN (SELECT key FROM e) GROUP BY key HAVING count(DISTINCT lower(p_brand)) = 1)
"""


@query(TIER_CTE + """
SELECT p_partkey, CASE WHEN o.key IS NOT NULL THEN 'override' WHEN e.key IS NOT NULL THEN 'exact' WHEN al.key IS NOT NULL AND (a.category IS NULL OR al.category IS NULL OR a.category = al.category) THEN 'alias' ELSE 'unmatched' END AS status,
       CASE WHEN o.key IS NOT NULL THEN o.slug WHEN e.key IS NOT NULL THEN e.slug WHEN al.key IS NOT NULL AND (a.category IS NULL OR al.category IS NULL OR a.category = al.category) THEN al.slug END AS slug
FROM a LEFT JOIN o USING (key) LEFT JOIN e USING (key) LEFT JOIN al USING (key)
""", rows="B26 C1 C2 C4")
def match_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_rows(spark, d)
    return M.tiered(rows, *tier_tables(rows)).select("p_partkey", "status", "slug")


@query(TIER_CTE + "SELECT key, slug FROM al", rows="C3")
def alias_unique(spark: SparkSession, d: str) -> DataFrame:
    return tier_tables(answer_rows(spark, d))[2].select("key", "slug")


@query("""
WITH own AS (SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN NULL ELSE 'own' || CAST(c_custkey AS VARCHAR) END AS target FROM customer WHERE c_acctbal < 500),
     seg AS (SELECT c_mktsegment, min(c_name) AS target FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment)
SELECT c_custkey, CASE WHEN own.c_custkey IS NOT NULL THEN own.target ELSE seg.target END AS target, own.c_custkey IS NOT NULL OR seg.c_mktsegment IS NOT NULL AS decided
FROM customer LEFT JOIN own USING (c_custkey) LEFT JOIN seg USING (c_mktsegment)
""", rows="C8 K3")
def override_precedence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_acctbal")
    own = rows.where("c_acctbal < 500").select("c_custkey", F.when(F.col("c_acctbal") >= -500, F.concat(F.lit("own"), F.col("c_custkey").cast("string"))).alias("target"))
    seg = rows.where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(F.min("c_name").alias("target"))
    return M.first_by_precedence(rows, [(own, ["c_custkey"]), (seg, ["c_mktsegment"])]).select("c_custkey", "target", "decided")


@query(None, rows="C5 C6")
def link_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items' first four words as sure surfaces and their third word as one to be judged, found in all documents."""
    words = F.split("text", r"\s+")
    items = table(spark, d, "benchmark").where("length(text) > 0").select(F.col("item_id").cast("string").alias("target"), words.alias("w"))
    lexicon = items.select(F.array_join(F.slice("w", 1, 4), " ").alias("surface"), "target", F.lit("auto").alias("tier")).unionByName(
        items.select(F.get("w", F.lit(2)).alias("surface"), "target", F.lit("gated").alias("tier"))
    )
    return M.link_mentions(table(spark, d, "documents").where("text is not null"), lexicon)


BASKET = "SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem"
CO = f"WITH p AS ({BASKET}), co AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM p x JOIN p y USING (l_orderkey) WHERE x.s < y.s GROUP BY ALL)"


def supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(CO + " SELECT a, b, n FROM co", rows="C10")
def mention_graph(spark: SparkSession, d: str) -> DataFrame:
    return supplier_pairs(spark, d)


@query(CO + """
, e AS (SELECT a, b, n FROM co UNION ALL SELECT b, a, n FROM co)
SELECT a, b, n, CAST(row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS INTEGER) AS rank FROM e WHERE n >= 2 QUALIFY rank <= 8
""", rows="C11")
def related_topk(spark: SparkSession, d: str) -> DataFrame:
    pairs = supplier_pairs(spark, d).where("n >= 2")
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return M.top_k(edges, "a", [F.desc("n"), F.asc("b")], 8)


@query("""
WITH e AS (SELECT l_suppkey AS a, l_partkey % 97 AS b, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT coalesce(f.a, r.b) AS a, coalesce(f.b, r.a) AS b, coalesce(f.n, 0) AS fwd, coalesce(r.n, 0) AS rev, coalesce(f.n, 0) + coalesce(r.n, 0) AS score
FROM e f FULL OUTER JOIN e r ON f.a = r.b AND f.b = r.a
""", rows="C11")
def bidirectional_score(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97).alias("b")).agg(F.count("*").alias("n"))
    return M.both_ways(edges)


@query("""
SELECT a.vec_id AS query_id, b.vec_id AS near_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) DESC, b.vec_id) <= 5
""", rows="C12")
def related_vector_topup(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of the same label to every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    hit = e.join(q, "label").where("vec_id <> query_id")
    scored = hit.select("query_id", F.col("vec_id").alias("near_id"), F.round(dot(F.col("q"), F.col("embedding")) / (norm(F.col("q")) * norm(F.col("embedding"))), 6).alias("score"))
    return M.top_k(scored, "query_id", [F.desc("score"), F.asc("near_id")], 5).drop("rank")


@query(f"""
WITH a AS (SELECT p_partkey, {P_KEY} AS key, p_brand, split_part(p_type, ' ', 1) AS kind FROM part),
     s AS (SELECT key, min(kind) AS section FROM a GROUP BY key HAVING count(DISTINCT kind) = 1),
     l AS (SELECT regexp_extract(key, '([a-z0-9]+)$', 1) AS tok, min(kind) AS section FROM a GROUP BY 1 HAVING count(DISTINCT kind) = 1),
     b AS (SELECT p_brand, min(kind) AS section FROM a GROUP BY 1)
SELECT p_partkey, coalesce(s.section, l.section, b.section) AS section, CASE WHEN s.section IS NOT NULL THEN 1 WHEN l.section IS NOT NULL THEN 2 ELSE 3 END AS tier
FROM a LEFT JOIN s USING (key) LEFT JOIN l ON regexp_extract(key, '([a-z0-9]+)$', 1) = tok LEFT JOIN b ON a.p_brand = b.p_brand
""", rows="C13 C14")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = answer_rows(spark, d).withColumn("tok", F.regexp_extract("key", r"([a-z0-9]+)$", 1))
    one = lambda k: a.groupBy(k).agg(F.min("category").alias("section"), F.count_distinct("category").alias("n")).where("n = 1").drop("n")
    s, l = one("key").withColumnRenamed("section", "s1"), one("tok").withColumnRenamed("section", "s2")
    b = a.groupBy("p_brand").agg(F.min("category").alias("s3"))
    rows = a.join(s, "key", "left").join(l, "tok", "left").join(b, "p_brand", "left")
    return rows.select("p_partkey", F.coalesce("s1", "s2", "s3").alias("section"), F.when(F.col("s1").isNotNull(), 1).when(F.col("s2").isNotNull(), 2).otherwise(3).alias("tier"))


@query("""
WITH k AS (SELECT DISTINCT p_name AS key FROM part)
SELECT a.key, b.key AS near, CAST(levenshtein(a.key, b.key) AS INTEGER) AS distance FROM k a JOIN k b ON a.key <> b.key AND levenshtein(a.key, b.key) <= 4
""", rows="C15")
def fuzzy_near_miss(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").select(F.col("p_name").alias("key")).distinct()
    return M.fuzzy_pairs(keys, keys, 4)


@query(None, rows="C15")
def fuzzy_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest names of each by ratio, among all with a ratio of 0.82 or more."""
    keys = table(spark, d, "part").select(F.col("p_name").alias("key")).distinct()
    return M.top_k(M.ratio_pairs(keys, keys), "key", [F.desc("ratio"), F.asc("near")], 3)


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(o.node, i.node) AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in
FROM (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1) o FULL OUTER JOIN (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1) i ON o.node = i.node
""", rows="C17")
def edge_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    out, in_ = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return out.join(in_, "node", "full_outer").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


@query("""
WITH rem AS (SELECT o_custkey, count(*) AS left_ FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT o_orderkey, o_custkey, left_ FROM orders LEFT JOIN rem USING (o_custkey)
WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY) ORDER BY left_, o_custkey, o_orderkey LIMIT 100
""", rows="C22")
def lease_claim(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred open or expired items, sets with fewest items left first; the limit is the claim's size."""
    orders = table(spark, d, "orders")
    left = orders.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("left_"))
    now = orders.agg(F.max("o_orderdate").alias("now"))
    open_ = M.claimable(orders.crossJoin(F.broadcast(now)), F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "P", F.col("o_orderdate"), F.col("now"), "365 days")
    return open_.join(left, "o_custkey", "left").select("o_orderkey", "o_custkey", "left_").orderBy(F.asc_nulls_last("left_"), "o_custkey", "o_orderkey").limit(100)


@query("""
SELECT p.event_id, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""", rows="C23")
def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    points = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    marks = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("mark"), "value")
    return as_of(points, marks, key="user_id", at="ts", mark_at="mark", value="value").select("event_id", "value")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band FROM customer
""", rows="C25")
def range_bucket(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([(-1e9, 0.0, "debt"), (0.0, 2500.0, "low"), (2500.0, 7500.0, "middle"), (7500.0, 1e9, "high")], "lo double, hi double, band string")
    rows = table(spark, d, "customer")
    return rows.join(F.broadcast(bands), (F.col("lo") <= F.col("c_acctbal")) & (F.col("c_acctbal") < F.col("hi"))).select("c_custkey", "band")


@query("""
SELECT c_custkey AS key, 'customer ' || c_mktsegment AS card, 'own' AS source FROM customer WHERE c_acctbal > 0
UNION ALL SELECT o_custkey, 'orders ' || CAST(count(*) AS VARCHAR), 'made' FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY o_custkey
""", rows="C26")
def card_synthesis(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.concat(F.lit("customer "), "c_mktsegment").alias("card"), F.lit("own").alias("source"))
    made = table(spark, d, "orders").withColumnRenamed("o_custkey", "key").join(own.select("key"), "key", "left_anti").groupBy("key").agg(F.concat(F.lit("orders "), F.count("*").cast("string")).alias("card"))
    return own.unionByName(made.withColumn("source", F.lit("made")))
