"""Pruning, precedence, name resolution, merges and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.match import top_k
from corpusloom.plans.filters import hierarchy
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 1", rows="B4")
def retro_prune(spark: SparkSession, d: str) -> DataFrame:
    """Ids whose row no longer matches go; unknown ids stay."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").where("quality is null or quality = 1").select("doc_id")


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey", rows="B11")
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    picks = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(picks, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, l_returnflag, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS number, l_partkey FROM lineitem WHERE l_linestatus = 'O'", rows="B17")
def sweep_view(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_returnflag", F.row_number().over(w).cast("long").alias("number"), "l_partkey")


@query("SELECT s_suppkey FROM supplier WHERE (CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END IS NULL) OR s_nationkey NOT IN (1, 2, 3)", rows="B18")
def map_filter(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey"))
    return table(spark, d, "supplier").where(group.isNull() | ~group.isin(1, 2, 3)).select("s_suppkey")


@query("""
SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%brass%' THEN 'metal/brass' WHEN p_size > 40 THEN 'large' WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'economy') THEN 'economy' ELSE NULL END AS unit FROM part
""", rows="B21")
def taxonomy_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Rules in order; none of them: no unit."""
    kind = F.lower("p_type")
    unit = F.when(F.contains(kind, F.lit("brass")), "metal/brass").when(F.col("p_size") > 40, "large").when(F.substring_index(kind, " ", 1) == "economy", "economy")
    return table(spark, d, "part").select("p_partkey", unit.alias("unit"))


@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN n = 1 THEN 'single' WHEN n <= 3 AND q >= 40 THEN 'thin' ELSE 'rich' END AS tier FROM o
""", rows="B22")
def work_tiers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return o.select("l_orderkey", F.when(F.col("n") == 1, "single").when((F.col("n") <= 3) & (F.col("q") >= 40), "thin").otherwise("rich").alias("tier"))


def nearest_of_group(rows: DataFrame, k: int) -> DataFrame:
    """(a, b, rank): the ``k`` others of the group ``s_nationkey`` with the nearest ``x``, ties to the smaller id; without a distance last.

    Of one value only its first k + 1 ids can count, and of other values the k on either side.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy("s_nationkey", *by).orderBy("id")) <= k + 1
    listed = lambda df, *by: df.groupBy("s_nationkey", *by).agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("same"))
    values = listed(rows.where("x is not null").withColumn("first", first("x")).where("first"), "x")
    order = Window.partitionBy("s_nationkey").orderBy("x")
    beside = [f("same", n).over(order) for f in (F.lag, F.lead) for n in range(1, k + 1)]
    values = values.select("s_nationkey", "x", F.flatten(F.array_compact(F.array("same", *beside))).alias("near"))
    # those without a balance, and the first of all for them
    ends = listed(rows.withColumn("first", first(F.col("x").isNull())).where("first")).withColumnRenamed("same", "ends")
    unlike = F.isnull("x") | F.isnan("x")
    found = rows.join(values, ["s_nationkey", "x"], "left").join(ends, "s_nationkey")
    ends_of = F.when(unlike, F.col("ends")).otherwise(F.filter("ends", lambda e: e["x"].isNull()))
    every = F.array_distinct(F.concat(F.coalesce("near", F.array().cast("array<struct<id:bigint,x:double>>")), ends_of))
    pairs = found.select(F.col("id").alias("a"), "x", F.explode(F.transform(every, lambda e: F.struct(e["id"].alias("b"), e["x"].alias("y")))).alias("e")).select("a", "x", "e.*").where("a <> b")
    return top_k(pairs, "a", [F.asc_nulls_last(F.abs(F.col("x") - F.col("y"))), F.col("b")], k)


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS INTEGER) AS rank FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey QUALIFY rank <= 5
""", rows="B26")
def same_category_related(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest balances of the same nation, from those next to one's own in their order; no pairs of a whole nation are made."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x")).where("s_nationkey is not null and id is not null")
    return nearest_of_group(s, 5).select("a", "b", "rank")


@query("SELECT CAST(pos AS BIGINT) AS pos, p_partkey FROM (SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, * FROM part) WHERE p_size = 10", rows="B27")
def card_table(spark: SparkSession, d: str) -> DataFrame:
    """A filtered row keeps the place it has in its unfiltered table."""
    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, d, "part").withColumn("pos", pos.cast("long")).where("p_size = 10").select("pos", "p_partkey")


@query("SELECT DISTINCT l_partkey FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)", rows="B29")
def missing_media(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    failed = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    works = table(spark, d, "lineitem").where("l_returnflag = 'N'").join(o, "l_orderkey", "left_semi").select("l_partkey").distinct()
    return works.join(failed, "l_partkey", "left_anti")


@query("""
WITH agent AS (SELECT l_suppkey AS topic, CASE WHEN l_quantity > 25 THEN l_returnflag END AS work FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
 fresh AS (SELECT l_suppkey AS topic, CASE WHEN l_quantity > 10 THEN l_returnflag END AS work FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT topic, work, 'agent' AS source FROM agent UNION ALL SELECT topic, work, 'scan' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM agent a WHERE a.topic = f.topic AND a.work IS NOT DISTINCT FROM f.work)
""", rows="C9")
def judgement_merge(spark: SparkSession, d: str) -> DataFrame:
    """Judged references stay as they are; fresh ones come in where (topic, work) is new, null works included."""
    rows = table(spark, d, "lineitem")
    refs = lambda status, least: rows.where(F.col("l_linestatus") == status).select(F.col("l_suppkey").alias("topic"), F.when(F.col("l_quantity") > least, F.col("l_returnflag")).alias("work")).distinct()
    agent, fresh = refs("F", 25), refs("O", 10)
    a = agent.toDF("a_topic", "a_work")
    new = fresh.join(a, (F.col("topic") == F.col("a_topic")) & F.col("work").eqNullSafe(F.col("a_work")), "left_anti")
    return agent.withColumn("source", F.lit("agent")).unionByName(new.withColumn("source", F.lit("scan")))


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT DISTINCT upper(p_name) AS given FROM part WHERE p_size < 10 UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part),
 r AS (SELECT given, name, CASE WHEN given = name THEN 1 WHEN {SLUG.format('given')} = {SLUG.format('name')} THEN 2 ELSE 3 END AS tier FROM t JOIN n ON given = name OR {SLUG.format('given')} = {SLUG.format('name')} OR contains({SLUG.format('name')}, {SLUG.format('given')}))
SELECT given, arg_min(name, (tier, name)) AS name, min(tier) AS tier FROM r GROUP BY given
""", rows="C16")
def loose_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Exact name, else slug, else the first name that holds the slug.

    Names of a catalogue are few; the last tier is a broadcast of the ones that no other tier resolves.
    """
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name")).distinct().withColumn("ns", X.slug(F.col("name")))
    given = part.where("p_size < 10").select(F.upper("p_name").alias("given")).union(part.select(F.substring_index("p_name", " ", 1))).distinct().withColumn("gs", X.slug(F.col("given")))
    one = given.join(names, F.col("given") == F.col("name")).select("given", "name", F.lit(1).alias("tier"))
    two = given.join(names, F.col("gs") == F.col("ns")).select("given", "name", F.lit(2).alias("tier"))
    known = one.unionByName(two)
    rest = given.join(known.select("given").distinct(), "given", "left_anti")
    words = names.withColumn("w", F.explode(F.array_distinct(F.split("ns", "-"))))
    # a slug of one word is a part of another's word: candidates share its first three letters somewhere
    three = F.explode(F.array_distinct(F.expr("transform(sequence(1, greatest(1, length(w) - 2)), i -> substring(w, i, 3))")))
    grams = words.select("name", "ns", three.alias("g")).distinct()
    third = rest.withColumn("g", F.substring("gs", 1, 3)).join(grams, "g").where(F.contains("ns", "gs")).select("given", "name", F.lit(3).alias("tier"))
    return known.unionByName(third).groupBy("given").agg(F.min_by("name", F.struct("tier", "name")).alias("name"), F.min("tier").alias("tier"))


@query("""
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source, substr(text, 1, 80) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1
""", rows="C18")
def result_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Results once for each opening of 80 characters, in the order of their rank."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.substring("text", 1, 80).alias("head"))
    w = Window.partitionBy("source", "head").orderBy(F.desc("n_chars"), "doc_id")
    kept = docs.withColumn("n", F.row_number().over(w)).where("n = 1")
    return kept.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))


@query("""
WITH e AS (SELECT c_custkey, c_name, c_nationkey FROM customer), t AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 GROUP BY 1), a AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT c_nationkey, CAST(count(coalesce(t.k, a.k)) AS BIGINT) AS have, count(*) AS total FROM e LEFT JOIN t ON c_custkey = t.k LEFT JOIN a ON c_nationkey = a.k GROUP BY c_nationkey
""", rows="C19")
def dual_key_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("m1", F.lit(1))
    a = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("m2", F.lit(1))
    rows = table(spark, d, "customer").join(t, "c_custkey", "left").join(a, "c_nationkey", "left")
    return rows.groupBy("c_nationkey").agg(F.count(F.coalesce("m1", "m2")).alias("have"), F.count("*").alias("total"))


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size < 20 THEN p_brand END, CASE WHEN p_retailprice > 1000 THEN p_type END, 'unknown') AS creator, coalesce(CASE WHEN p_size >= 30 THEN p_type END, p_brand) AS era FROM part WHERE p_name IS NOT NULL
""", rows="C20")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Field by field the first source with a value."""
    creator = F.coalesce(F.when(F.col("p_size") < 20, F.col("p_brand")), F.when(F.col("p_retailprice") > 1000, F.col("p_type")), F.lit("unknown"))
    return table(spark, d, "part").where("p_name is not null").select("p_partkey", creator.alias("creator"), F.coalesce(F.when(F.col("p_size") >= 30, F.col("p_type")), "p_brand").alias("era"))


@query("SELECT l_partkey, arg_max(l_suppkey, (l_quantity, -l_suppkey)) AS entity, max(l_quantity) AS links FROM lineitem WHERE l_quantity >= 3 AND l_returnflag <> 'A' GROUP BY l_partkey", rows="C21")
def entity_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The most linked candidate of an admitted type."""
    rows = table(spark, d, "lineitem").where("l_quantity >= 3 and l_returnflag <> 'A'")
    return rows.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct(F.col("l_quantity"), -F.col("l_suppkey"))).alias("entity"), F.max("l_quantity").alias("links"))


@query("SELECT n_name AS unit, CAST(count(c_custkey) AS BIGINT) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON n_nationkey = c_nationkey GROUP BY n_name", rows="C28")
def unit_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("m"))
    return table(spark, d, "nation").join(g, "n_nationkey", "left").select(F.col("n_name").alias("unit"), F.coalesce("m", F.lit(0)).alias("n"))


@query("SELECT l_orderkey, CAST(count(*) FILTER (WHERE p_partkey IS NOT NULL) AS BIGINT) AS cleared, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size = 1) ON l_partkey = p_partkey GROUP BY l_orderkey", rows="C29")
def propagating_update(spark: SparkSession, d: str) -> DataFrame:
    """References to broken targets are cleared wherever they stand."""
    broken = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("bad"))
    return table(spark, d, "lineitem").join(broken, "l_partkey", "left").groupBy("l_orderkey").agg(F.count_if(F.col("bad")).alias("cleared"), F.count("*").alias("n"))


@query("""
SELECT p_name AS name, CAST(max(p_partkey) AS BIGINT) AS full_winner, CAST(min(p_partkey) FILTER (WHERE p_size > 25) AS BIGINT) AS alias_winner FROM part GROUP BY p_name
""", rows="C7 D22")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    """Of full names the last wins, of aliases the first."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("full_winner"), F.min(F.when(F.col("p_size") > 25, F.col("p_partkey"))).alias("alias_winner"))


@query("SELECT lower(c_name) AS key FROM customer UNION SELECT lower(s_name) FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(c_name) FROM customer)", rows="F10")
def queue_edits(spark: SparkSession, d: str) -> DataFrame:
    """New topics join a queue unless it holds them in any case."""
    queue = table(spark, d, "customer").select(F.lower("c_name").alias("key"))
    new = table(spark, d, "supplier").select(F.lower("s_name").alias("key")).join(queue, "key", "left_anti")
    return queue.union(new).distinct()


@query("""
SELECT c_custkey, coalesce(n_name, r_name) AS place FROM (SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 4 LEFT JOIN (SELECT min(r_name) AS r_name FROM region) ON true)
""", rows="I10")
def place_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Exact place, else the first known fallback."""
    nations = table(spark, d, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    fallback = table(spark, d, "region").agg(F.min("r_name").alias("r_name"))
    rows = table(spark, d, "customer").join(nations, "c_nationkey", "left").crossJoin(F.broadcast(fallback))  # one row
    return rows.select("c_custkey", F.coalesce("n_name", "r_name").alias("place"))
