"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources import tables as T
from corpusloom.sources.tables import table


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", rows="G1")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).subtract(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")))


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", rows="G1")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).intersect(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")))


@query("SELECT user_id, ts, min(event_id) AS event_id, 1 AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error') GROUP BY user_id, ts", rows="G2")
def log_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping logs become one; the first record of a key wins."""
    e = table(spark, d, "events")
    both = e.unionByName(e.where("event_type = 'error'"))
    return T.first_wins(both, ["user_id", "ts"], [F.col("event_id")]).select("user_id", "ts", "event_id", F.lit(1).alias("n"))


@query("""
SELECT user_id, array_to_string(list_sort(list_filter(u, lambda x: NOT list_contains(a, x))), ',') AS only_late FROM (
 SELECT user_id, list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS u, coalesce(list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-15'), []) AS a FROM events GROUP BY user_id)
WHERE u IS NOT NULL
""", rows="G3")
def set_difference_per_key(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("ts") >= F.expr("timestamp_ntz'2024-01-15'")
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(late, F.col("event_type"))).alias("u"), F.collect_set(F.when(~late, F.col("event_type"))).alias("a"))
    return g.where(F.size("u") > 0).select("user_id", F.array_join(F.array_sort(F.array_except("u", "a")), ",").alias("only_late"))


@query("""
WITH done AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), art AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 10)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND l_orderkey IS NULL THEN 'todo' WHEN l_orderkey IS NOT NULL THEN 'done' ELSE 'open' END AS status FROM orders LEFT JOIN art ON o_orderkey = l_orderkey
""", rows="G4")
def queue_reconcile(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(True))
    status = F.when((F.col("o_orderstatus") == "F") & F.col("there").isNull(), "todo").when(F.col("there"), "done").otherwise("open")
    return table(spark, d, "orders").join(art, "o_orderkey", "left").select("o_orderkey", status.alias("status"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY o_custkey", rows="G6")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("""
SELECT conv_id, CAST(count(*) FILTER (WHERE role = 'user' AND text IS DISTINCT FROM nxt) AS BIGINT) AS stale FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) GROUP BY conv_id
""", rows="G5")
def stale_text(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("nxt", nxt)
    return rows.groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & ~F.col("text").eqNullSafe(F.col("nxt"))).alias("stale"))
