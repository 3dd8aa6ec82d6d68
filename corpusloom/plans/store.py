"""Stores, shards, manifests, worklists and log ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import norm
from corpusloom.plans.registry import query
from corpusloom.sources import tables as T
from corpusloom.sources.tables import numbered, table


@query("""
SELECT vec_id, CASE WHEN label = 3 THEN 'new' ELSE 'old' END AS model, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * CASE WHEN label = 3 THEN 2 ELSE 1 END, 5) AS length FROM embeddings
""", rows="A7")
def vector_store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A second put of label 3 replaces its vectors; the newest of a key wins."""
    old = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.lit("old").alias("model"), F.lit(0).alias("at"))
    new = old.where("label = 3").withColumn("v", F.transform("v", lambda x: x * 2)).withColumn("model", F.lit("new")).withColumn("at", F.lit(1))
    return T.upsert(old.unionByName(new), ["vec_id"], [F.col("at")]).select("vec_id", "model", F.round(norm(F.col("v")), 5).alias("length"))


@query("SELECT conv_id AS id, turn - 1 AS part, CASE WHEN turn = 0 THEN 'leadin' ELSE 'part' END AS kind, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE length(text) >= 15", rows="A8 K1")
def text_sources(spark: SparkSession, d: str) -> DataFrame:
    """Texts to embed: parts keep their number although short ones fall out."""
    rows = table(spark, d, "conversations").where(F.length("text") >= 15)
    return rows.select(F.col("conv_id").alias("id"), (F.col("turn") - 1).alias("part"), F.when(F.col("turn") == 0, "leadin").otherwise("part").alias("kind"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('fr', 'de') GROUP BY lang", rows="A10")
def shard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Shards by language are written to the shared folder and two of them read back by partition pruning."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shards"
    at = f"{root.rstrip('/')}/shards-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(at)
    return spark.read.parquet(at).where("lang in ('fr', 'de')").groupBy("lang").agg(F.count("*").alias("n"))


def whole_or_fail(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``refs`` if every key is known; a dangling one fails the job before anything is written."""
    missing = refs.join(known.select(key), key, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"dangling reference: {missing[0][key]}")
    return refs


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey", rows="A13")
def integrity_abort(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return whole_or_fail(table(spark, d, "lineitem").select("l_orderkey"), known, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
SELECT c.conv_id, c.turn, CAST(length(trim(l.text || ' ' || c.text)) AS BIGINT) AS n_chars, md5(trim(l.text || ' ' || c.text)) AS panel
FROM conversations c JOIN conversations l ON c.conv_id = l.conv_id AND l.turn = 0 WHERE c.turn > 0
""", rows="A14")
def unit_panels(spark: SparkSession, d: str) -> DataFrame:
    """Every part behind its lead-in."""
    c = table(spark, d, "conversations")
    lead = c.where("turn = 0").select("conv_id", F.col("text").alias("lead"))
    rows = c.where("turn > 0").join(lead, "conv_id")
    panel = F.trim(F.concat("lead", F.lit(" "), "text"))
    return rows.select("conv_id", "turn", F.length(panel).cast("long").alias("n_chars"), F.md5(panel.cast("binary")).alias("panel"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 0) WHERE n <= 60", rows="A21")
def capped_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Valid, distinct pushes up to each user's quota, which is the feature; a repeated push is a no-op."""
    e = table(spark, d, "events").where("value > 0")
    seen = T.first_wins(e.unionByName(e), ["user_id", "event_id", "ts"], [F.col("event_id")])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return seen.withColumn("n", F.row_number().over(w)).where("n <= 60").select("user_id", "event_id", "ts")


@query("SELECT user_id, max(ts) AS updated, arg_max(value, (ts, event_id)) AS value, CAST(count(*) - 1 AS BIGINT) AS older FROM events GROUP BY user_id", rows="A23")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id"))
    g = table(spark, d, "events").groupBy("user_id").agg(newest.alias("r"), (F.count("*") - 1).alias("older"))
    return g.select("user_id", F.col("r.ts").alias("updated"), F.col("r.value").alias("value"), "older")


@query("SELECT CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS joined, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS bad FROM events", rows="A26")
def jsonl_compose(spark: SparkSession, d: str) -> DataFrame:
    """Answers as JSON lines come back: good ones join their item by the echoed id, bad lines are counted."""
    e = table(spark, d, "events")
    lines = e.select("event_id", F.when(F.col("event_type") == "error", F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), "event_type"))).alias("line"))
    parsed = lines.select(F.from_json("line", "id long, event_type string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r._corrupt is null").select(F.col("r.id").alias("event_id"))
    joined = e.select("event_id").join(good, "event_id").agg(F.count("*").alias("joined"))
    return joined.crossJoin(parsed.agg(F.count_if(F.col("r._corrupt").isNotNull()).alias("bad")))  # one row each


@query("""SELECT page_id, regexp_extract(substr(html, 1, 500), '<html lang="([a-z]+)"', 1) AS lang, CAST(length(substr(html, 1, 500)) AS BIGINT) AS n_read FROM pages""", rows="A29")
def header_scrape(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring("html", 1, 500)
    return table(spark, d, "pages").select("page_id", F.regexp_extract(head, '<html lang="([a-z]+)"', 1).alias("lang"), F.length(head).cast("long").alias("n_read"))


@query("SELECT o_orderkey, right(CAST(o_orderkey AS VARCHAR), 2) AS shard, lower(o_orderpriority[1:1]) || '/' || right(CAST(o_orderkey AS VARCHAR), 2) || '/' || CAST(o_orderkey AS VARCHAR) || '.opus' AS path FROM orders WHERE o_orderpriority[1:1] IN ('1', '2')", rows="A33")
def audio_worklist(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    shard = F.when(F.length(key) < 2, key).otherwise(F.substring(key, -2, 2))
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").where(first.isin("1", "2")).select("o_orderkey", shard.alias("shard"), F.concat(F.lower(first), F.lit("/"), shard, F.lit("/"), key, F.lit(".opus")).alias("path"))


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000", rows="A34")
def manifest_union(spark: SparkSession, d: str) -> DataFrame:
    local = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    remote = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    return local.union(remote).distinct()


@query("""
SELECT c_custkey, c_name AS title, CAST(count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS n_works, CAST(count(o_orderkey) AS BIGINT) AS n_all FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL
""", rows="A36")
def guide_table(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("w"), F.count("*").alias("a"))
    rows = table(spark, d, "customer").join(o, "c_custkey", "left")
    return rows.select("c_custkey", F.col("c_name").alias("title"), F.coalesce("w", F.lit(0)).alias("n_works"), F.coalesce("a", F.lit(0)).alias("n_all"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 400) AS BIGINT) AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", rows="A41")
def incremental_shipping(spark: SparkSession, d: str) -> DataFrame:
    """Batches of what isn't shipped yet; places come from counts by range, so no task holds all rows."""
    todo = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")
    return numbered(todo, ["doc_id"], "n", F.floor(F.col("doc_id") / 4096)).select("doc_id", F.floor(F.col("n") / 400).cast("long").alias("batch"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS q FROM events)
SELECT user_id, q AS question, CASE WHEN bool_or(event_type = 'error') THEN 'W' WHEN bool_or(event_type = 'purchase') THEN 'C' ELSE 'D' END AS res,
 min(event_id) FILTER (WHERE (ts, event_id) = f) AS first_buzz, count(*) AS n FROM (SELECT *, min(CASE WHEN event_type IN ('error', 'purchase') THEN (ts, event_id) END) OVER (PARTITION BY user_id, q) AS f FROM e) GROUP BY ALL
""", rows="J6")
def question_machine(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question of a user: a view opens it, any error makes it wrong, the first buzz is credited."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("question", F.count(F.when(F.col("event_type") == "view", 1)).over(w))
    buzz = F.col("event_type").isin("error", "purchase")
    wrong, right = F.max(F.col("event_type") == "error"), F.max(F.col("event_type") == "purchase")
    first = F.min_by("event_id", F.when(buzz, F.struct("ts", "event_id")))
    return e.groupBy("user_id", "question").agg(F.when(wrong, "W").when(right, "C").otherwise("D").alias("res"), first.alias("first_buzz"), F.count("*").alias("n"))
