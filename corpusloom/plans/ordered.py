"""Windows, replays, sampling and null-aware sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import hash_unit
from corpusloom.operators import ordered as O
from corpusloom.plans.aggregations import LOG
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

@query(f"""
WITH {LOG}, r AS (SELECT uid, event_id, row_number() OVER w AS pos, count(*) OVER f AS n, CAST(sum(CASE WHEN res = 'C' THEN 1 ELSE 0 END) OVER f AS BIGINT) AS k, count(*) OVER (PARTITION BY uid) AS total FROM log
 WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id), f AS (PARTITION BY uid ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT uid, event_id, n, k, round(k / n, 6) AS acc,
 round(greatest(0.0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS lo,
 round(least(1.0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS hi
FROM r WHERE pos >= least(greatest(2, least(50, total)), 12)
""", rows="E1 E2")
def rolling_wilson(spark: SparkSession, d: str) -> DataFrame:
    out = O.rolling_accuracy(O.attempts(table(spark, d, "events")), 50)
    return out.select("uid", "event_id", "n", F.col("k").cast("long").alias("k"), *(F.round(c, 6).alias(c) for c in ("acc", "lo", "hi")))


@query(f"""
WITH {LOG}, r AS (SELECT uid, event_id, count(CASE WHEN res = 'C' THEN bf END) OVER f AS n, avg(CASE WHEN res = 'C' THEN 1 - bf END) OVER f AS mean FROM log
 WINDOW f AS (PARTITION BY uid ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))
SELECT uid, event_id, n, round(mean, 9) AS mean FROM r WHERE n >= 5
""", rows="E3")
def rolling_celerity(spark: SparkSession, d: str) -> DataFrame:
    log = O.attempts(table(spark, d, "events"))
    out = O.rolling_mean(log, 1 - F.col("bf"), F.col("res") == "C", 40, 5)
    return out.select("uid", "event_id", "n", F.round("mean", 9).alias("mean"))


@query(f"""
WITH {LOG}, g AS (SELECT uid, event_type, count(*) AS n FROM log GROUP BY ALL HAVING count(*) >= 10), t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, event_type) AS p FROM g)
SELECT l.uid, l.event_type, l.event_id, CAST(row_number() OVER (PARTITION BY l.uid, l.event_type ORDER BY ts, event_id) AS BIGINT) AS pos,
 round(avg(bf) OVER (PARTITION BY l.uid, l.event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS mean FROM log l JOIN t ON l.uid = t.uid AND l.event_type = t.event_type AND p <= 6
""", rows="E4")
def split_series(spark: SparkSession, d: str) -> DataFrame:
    log = O.attempts(table(spark, d, "events"))
    g = log.groupBy("uid", "event_type").agg(F.count("*").alias("n")).where("n >= 10")
    top = g.withColumn("p", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("n"), "event_type"))).where("p <= 6").select("uid", "event_type")
    w = Window.partitionBy("uid", "event_type").orderBy("ts", "event_id")
    return log.join(top, ["uid", "event_type"]).select(
        "uid", "event_type", "event_id", F.row_number().over(w).cast("long").alias("pos"), F.round(F.avg("bf").over(w.rowsBetween(-9, 0)), 9).alias("mean")
    )


SRS_SQL = f"""
WITH RECURSIVE {LOG}, c AS (SELECT uid, k, res, least(1.0, greatest(0.0, 1 - coalesce(bf, 0.5))) AS q, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) - 1 AS clock FROM log),
 s AS (SELECT uid, k, res, q, clock, row_number() OVER (PARTITION BY uid, k ORDER BY clock) AS i, count(*) OVER (PARTITION BY uid, k) AS n FROM c WHERE k IS NOT NULL),
 f AS (
  SELECT uid, k, CAST(0 AS BIGINT) AS i, CAST(2.0 AS DOUBLE) AS stab, CAST(5.0 AS DOUBLE) AS diff, CAST(0 AS BIGINT) AS lapses, CAST(0 AS BIGINT) AS last FROM s WHERE i = 1
  UNION ALL
  SELECT uid, k, i, CASE WHEN res = 'C' THEN least(500.0, stab * (1 + (11 - diff) / 10 * (0.4 + q))) ELSE greatest(1.0, stab * 0.35) END, diff, lapses, clock FROM (
   SELECT f.uid, f.k, s.i, res, q, stab, lapses + CASE WHEN res = 'C' THEN 0 ELSE 1 END AS lapses, s.clock,
    least(10.0, greatest(1.0, diff + CASE res WHEN 'C' THEN -0.15 * (q - 0.4) WHEN 'W' THEN 1.1 ELSE 0.8 END)) AS diff
   FROM f JOIN s ON f.uid = s.uid AND f.k = s.k AND s.i = f.i + 1)),
 z AS (SELECT f.* FROM f JOIN (SELECT DISTINCT uid, k, n FROM s) e ON f.uid = e.uid AND f.k = e.k AND f.i = e.n)
"""


@query(SRS_SQL + "SELECT uid, k, i AS reps, lapses, last, round(stab, 6) AS stab, round(diff, 6) AS diff FROM z", rows="E6 J3")
def srs_state(spark: SparkSession, d: str) -> DataFrame:
    state = O.replay(O.clocked(O.attempts(table(spark, d, "events"))).where("k is not null"))
    return state.select("uid", "k", F.col("reps").cast("long").alias("reps"), F.col("lapses").cast("long").alias("lapses"), "last", F.round("stab", 6).alias("stab"), F.round("diff", 6).alias("diff"))


@query(SRS_SQL + """, m AS (SELECT uid, count(*) - last AS elapsed, z.k, stab, diff, lapses FROM z JOIN log USING (uid) GROUP BY uid, z.k, last, stab, diff, lapses)
SELECT uid, k, round(CASE WHEN elapsed < 8 THEN 0.001 ELSE greatest((1.0::DOUBLE - 0.6::DOUBLE * 0.5) * greatest(0.0::DOUBLE, 0.9::DOUBLE - 1 / (1 + elapsed / (9 * stab))) + (0.3::DOUBLE + 1.2::DOUBLE * 0.5) * (diff / 10 * (1 + 0.15::DOUBLE * lapses)) + 0.001::DOUBLE, 0.0001::DOUBLE) END, 6) AS weight FROM m""", rows="E7")
def drill_weight(spark: SparkSession, d: str) -> DataFrame:
    log = O.clocked(O.attempts(table(spark, d, "events")))
    now = log.groupBy("uid").agg(F.count("*").alias("now"))
    return O.drill_weight(O.replay(log.where("k is not null")).join(now, "uid"), F.col("now")).select("uid", "k", F.round("weight", 6).alias("weight"))


@query(f"""
WITH {LOG}, w AS (SELECT uid, k % 7 AS section, k % 3 AS sub, CASE WHEN res = 'C' THEN 0.5 * coalesce(bf, 0.5) ELSE 1.0 END AS w FROM log), a AS (SELECT uid, avg(w) AS w0 FROM w GROUP BY uid),
 s AS (SELECT uid, section, (sum(w) + 5 * any_value(w0)) / (count(*) + 5) AS ws FROM w JOIN a USING (uid) WHERE section IS NOT NULL GROUP BY ALL),
 t AS (SELECT uid, sub, (sum(w) + 5 * any_value(w0)) / (count(*) + 5) AS wt FROM w JOIN a USING (uid) WHERE sub IS NOT NULL GROUP BY ALL),
 c AS (SELECT DISTINCT section, sub FROM w WHERE section IS NOT NULL)
SELECT a.uid, c.section, c.sub, round((0.2::DOUBLE + 0.8::DOUBLE * 0.5) * (0.5 + coalesce(ws, w0) * coalesce(wt, w0)) + 0.4::DOUBLE, 6) AS weight
FROM a CROSS JOIN c LEFT JOIN s ON s.uid = a.uid AND s.section = c.section LEFT JOIN t ON t.uid = a.uid AND t.sub = c.sub
""", rows="E7")
def drill_new_weight(spark: SparkSession, d: str) -> DataFrame:
    """Weights of items without reviews; an item's section and sub are taken from its number."""
    log = O.attempts(table(spark, d, "events")).select("uid", "res", "bf", (F.col("k") % 7).alias("section"), (F.col("k") % 3).alias("sub"))
    return O.new_item_weight(log, section="section", sub="sub").withColumn("weight", F.round("weight", 6))


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || CAST(n AS VARCHAR) END AS slug FROM (
 SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') ORDER BY p_partkey) AS n FROM part)
""", rows="E8")
def dedupe_suffix(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.text import slug

    rows = table(spark, d, "part").select("p_partkey", slug(F.col("p_name")).alias("base"))
    return O.suffix_numbers(rows, "base", [F.col("p_partkey")], "slug").select("p_partkey", "slug")


@query("""
SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE p = floor(n / 2) + 1
""", rows="E9")
def median_pick(spark: SparkSession, d: str) -> DataFrame:
    return O.upper_median(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.col("n_chars"), F.col("doc_id")])


@query("""
SELECT p_partkey, CAST(row_number() OVER (ORDER BY round(pow((CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8)) AS UBIGINT) + 1.0) / 4294967296.0, 1.0 / (1 + p_size)), 12) DESC, p_partkey) AS BIGINT) AS rank FROM part QUALIFY rank <= 50
""", rows="F7")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty parts drawn without replacement, by u^(1/w) with a hash for u; the limit is the sample's size."""
    key = F.round(F.pow(hash_unit(F.col("p_partkey").cast("string")), 1.0 / (1 + F.col("p_size"))), 12)
    top = table(spark, d, "part").select("p_partkey", key.alias("key")).orderBy(F.desc("key"), "p_partkey").limit(50)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("key"), "p_partkey")).cast("long").alias("rank"))


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS BIGINT) AS pos FROM orders
""", rows="F8")
def null_sorts(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice"))
    w = Window.partitionBy("o_orderpriority").orderBy(value.desc_nulls_last(), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("pos"))


@query("SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) <= 20", rows="F9")
def pop_n(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty open orders of each priority; the limit is the pop's size."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").where("o_orderstatus = 'O'").withColumn("n", F.row_number().over(w)).where("n <= 20").select("o_orderpriority", "o_orderkey")
