"""Queries over topics, their queues and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import topics as O
from corpusloom.operators.ordered import attempts
from corpusloom.plans.aggregations import LOG
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

WORK = "CASE WHEN p_size < 5 THEN 'General ' || p_name WHEN p_size < 8 THEN 'Biographical' WHEN p_size < 11 THEN 'Other ' || p_type WHEN p_size < 14 THEN 'Others' ELSE p_name END"


@query(f"""
SELECT p_brand, count(*) FILTER (WHERE NOT (contains(w, 'General') OR contains(w, 'Biographical') OR contains(w, 'Other '))) AS n_real, count(*) AS n_works FROM (SELECT p_brand, {WORK} AS w FROM part) GROUP BY p_brand
""", rows="B20")
def real_works(spark: SparkSession, d: str) -> DataFrame:
    """Works of each brand that aren't groupings."""
    works = table(spark, d, "part").select("p_brand", F.expr(WORK).alias("w"))
    return works.groupBy("p_brand").agg(F.count_if(O.is_real_work(F.col("w"))).alias("n_real"), F.count("*").alias("n_works"))


@query("""
WITH n AS (SELECT n_name FROM nation WHERE n_regionkey < 3), c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'The ' || n_name WHEN c_acctbal < 2000 THEN lower(n_name) ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, name, name IN (SELECT n_name FROM n) OR regexp_replace(name, '^The ', '') IN (SELECT n_name FROM n) AS is_place FROM c
""", rows="B20")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("The "), "n_name")).when(F.col("c_acctbal") < 2000, F.lower("n_name")).otherwise(F.col("n_name"))
    return O.is_place(rows.select("c_custkey", name.alias("name")), "name", nations.where("n_regionkey < 3"), "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000000')", rows="B25")
def set_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(O.name_holds(F.col("c_name"), "R#0000000")).select("c_custkey", "c_name")


@query("""
WITH r AS (SELECT doc_id, toxic = 1 AS flagged FROM documents LEFT JOIN labels USING (doc_id))
SELECT mode, doc_id FROM r, (VALUES ('all'), ('review'), ('ok')) m(mode) WHERE mode = 'all' OR (mode = 'review') = coalesce(flagged, false)
""", rows="B28")
def review_modes(spark: SparkSession, d: str) -> DataFrame:
    """What a review shows in each of its modes; documents without a label aren't flagged."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("flagged")), "doc_id", "left")
    shown = F.array_compact(F.array(*(F.when(O.in_review(F.col("flagged"), m), m) for m in O.MODES)))
    return rows.select(F.explode(shown).alias("mode"), "doc_id")


@query("""
WITH q AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'first' ELSE 'second' END AS queue, coalesce(CASE WHEN o_totalprice > 1000 THEN o_orderpriority END, 'Unknown') AS category FROM orders WHERE o_orderstatus IN ('O', 'F'))
SELECT queue, category, count(*) AS n FROM q GROUP BY GROUPING SETS ((queue, category), (queue))
""", rows="D29")
def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both passes by category, with totals."""
    rows = table(spark, d, "orders").withColumn("category", F.when(F.col("o_totalprice") > 1000, F.col("o_orderpriority")))
    return O.queue_summary({"first": rows.where("o_orderstatus = 'O'"), "second": rows.where("o_orderstatus = 'F'")}, "category")


@query("""
WITH c AS (SELECT o_custkey, count(DISTINCT o_orderkey) // 4 AS works, count(*) AS questions FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
 t AS (SELECT c_name AS topic, c_mktsegment AS category, works, questions, CASE WHEN works <= 2 AND questions >= 15 THEN 'definite' WHEN works <= 3 AND questions >= 20 THEN 'likely' ELSE 'maybe' END AS tier FROM c JOIN customer ON o_custkey = c_custkey),
 q AS (SELECT upper(c_name) AS topic, c_mktsegment AS category FROM customer WHERE c_acctbal < 500)
SELECT topic, category, NULL AS reason FROM q
UNION ALL SELECT topic, category, 'redo: ' || works || ' works from ' || questions || ' questions (tier=' || tier || ')' FROM t WHERE tier <> 'maybe' AND lower(topic) NOT IN (SELECT lower(topic) FROM q)
""", rows="F11")
def redo_queue(spark: SparkSession, d: str) -> DataFrame:
    """Customers with few works from many questions join a queue that doesn't hold them."""
    customer = table(spark, d, "customer")
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    # lines of an order first, so that a customer's orders are counted without gathering them
    counts = lines.groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("k")).groupBy("o_custkey").agg(F.floor(F.count("*") / 4).alias("works"), F.sum("k").alias("questions"))
    candidates = counts.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("topic"), F.col("c_mktsegment").alias("category"), "works", "questions", "c_custkey")
    queue = customer.where("c_acctbal < 500").select(F.upper("c_name").alias("topic"), F.col("c_mktsegment").alias("category"))
    return O.enqueued(queue, candidates, order=[F.col("c_custkey")]).select("topic", "category", "reason")


@query("""
SELECT p_partkey, regexp_replace('the ' || p_name || ', a ' || p_name, '(' || split_part(p_name, ' ', 2) || ')', '<mark>\\1</mark>', 'gi') AS shown,
 p_name || CASE WHEN p_size > 10 THEN ' (d' || least(p_size, 20, p_size // 2) || '–' || greatest(p_size, 20, p_size // 2) || ')' ELSE '' END || CASE WHEN p_retailprice > 950 THEN ' mentions' ELSE '' END AS label FROM part
""", rows="H25")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Names with their second word marked, and the labels of their tabs."""
    part = table(spark, d, "part")
    text = F.concat(F.lit("the "), "p_name", F.lit(", a "), "p_name")
    size = F.col("p_size")
    difficulties = F.when(size > 10, F.array(size, F.lit(20), F.floor(size / 2).cast("int")))
    return part.select("p_partkey", O.highlighted(text, F.upper(F.get(F.split("p_name", " "), F.lit(1)))).alias("shown"), O.tab_label(F.col("p_name"), difficulties, F.col("p_retailprice") > 950).alias("label"))


@query("""
WITH e AS (SELECT p_partkey, 0 AS s, 0 AS e, p_name AS answerline, string_split(p_name, ' ') AS works, p_brand AS section FROM part UNION ALL SELECT p_partkey, 0, 1, p_type, [], p_brand FROM part UNION ALL SELECT p_partkey, 1, 0, upper(p_name), [p_type], 'rest' FROM part),
 w AS (SELECT p_partkey, section, s, e, 0 AS w, answerline FROM e UNION ALL SELECT p_partkey, section, s, e, i, works[i] FROM e, range(1, 10) r(i) WHERE i <= len(works))
SELECT p_partkey, section, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s, e, w) - 1 AS INTEGER) AS pos, CAST(w > 0 AS INTEGER) AS depth, answerline FROM w
""", rows="I8")
def overview_entries(spark: SparkSession, d: str) -> DataFrame:
    """Nested overviews, one of each part, as rows: an entry, then its works."""
    leaf = lambda a: F.struct(a.alias("answerline"), F.array().cast("array<string>").alias("variants"))
    entry = lambda a, works: F.struct(a.alias("answerline"), F.array(F.lower(a)).alias("variants"), F.transform(works, leaf).alias("works"))
    name, kind = F.col("p_name"), F.col("p_type")
    none = F.array().cast("array<string>")
    section = lambda n, *entries: F.struct(n.alias("name"), F.array(*entries).alias("entries"))
    sections = F.array(section(F.col("p_brand"), entry(name, F.split(name, " ")), entry(kind, none)), section(F.lit("rest"), entry(F.upper(name), F.array(kind))))
    found = O.placed_entries(table(spark, d, "part").select("p_partkey", sections.alias("sections")), "p_partkey")
    return found.select("p_partkey", "section", "pos", "depth", "answerline")


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_quantity <= 25) AS n_tossups, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_quantity > 25), '') AS bonuses,
 CAST(coalesce(sum(CASE WHEN l_returnflag = 'N' THEN 5 + 10 + l_linenumber ELSE 30 END) FILTER (WHERE l_quantity > 25), 0) AS BIGINT) AS worth FROM lineitem GROUP BY l_orderkey
""", rows="A39")
def packet_export(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a packet: tossups, and bonuses with their values, ten a part where there are none or broken ones."""
    line = table(spark, d, "lineitem")
    values = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("[5,10,"), F.col("l_linenumber").cast("string"), F.lit("]"))).when(F.col("l_returnflag") == "R", "[5,")
    rows = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, "bonus").otherwise("tossup").alias("kind"), F.col("l_partkey").cast("string").alias("text"), F.array(F.col("l_suppkey").cast("string")).alias("parts"), values.alias("worth"))
    found = O.packets(rows, packet="l_orderkey", number="l_linenumber", kind="kind", text="text", parts="parts", values="worth")
    total = F.aggregate("bonuses", F.lit(0).cast("long"), lambda s, b: s + F.aggregate(b["values"], F.lit(0).cast("long"), lambda t, v: t + v))
    return found.select("l_orderkey", F.size("tossups").cast("long").alias("n_tossups"), F.array_join(F.transform("bonuses", lambda b: b["number"].cast("string")), ",").alias("bonuses"), total.alias("worth"))


def reader_breakdown() -> O.Breakdown:
    """What an attempt log can be broken down by, and what can be shown of it."""
    right = F.col("res") == "C"
    points = F.when(right & (F.col("bf") < 0.5), 15).when(right, 10).when(F.col("res") == "W", -5).otherwise(0)
    return O.Breakdown(
        {"kind": F.col("event_type"), "item": F.col("k"), "depth": F.when(F.col("bf") < 0.5, "early").otherwise("late")},
        {"n": F.count("*"), "acc": F.round(F.avg(right.cast("double")), 6), "neg": F.round(F.avg((F.col("res") == "W").cast("double")), 6), "ppq": F.round(F.avg(points.cast("double")), 6)},
    )


@query(f"""
WITH {LOG}
SELECT event_type AS kind, CASE WHEN bf < 0.5 THEN 'early' ELSE 'late' END AS depth, count(*) AS n, round(avg(CASE WHEN res = 'C' AND bf < 0.5 THEN 15.0 WHEN res = 'C' THEN 10.0 WHEN res = 'W' THEN -5.0 ELSE 0.0 END), 6) AS ppq, CAST(max(k) AS BIGINT) AS furthest FROM log GROUP BY ALL
""", rows="K2")
def pluggable_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Two of three dimensions, and metrics of which one was added by its user."""
    shown = reader_breakdown().with_(metrics={"furthest": F.max("k")})
    return shown(attempts(table(spark, d, "events")), ["depth", "kind"], ["n", "ppq", "furthest"])
