"""Streams drained over the event table, each with its batch result as the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ordered import attempts
from corpusloom.plans.ordered import SRS_SQL
from corpusloom.plans.registry import query
from corpusloom.streaming import log as L
from corpusloom.streaming import stateful as S


def stream(spark: SparkSession, d: str) -> DataFrame:
    return L.log_stream(spark, f"{d.rstrip('/')}/events.parquet")


@query("SELECT event_id, user_id, event_type FROM events", rows="J2")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event is pushed twice and kept once; an event's second push may be up to an hour late."""
    events = stream(spark, d).select("event_id", "user_id", "event_type", "at")
    found = L.deduplicated(events.unionByName(stream(spark, d).select("event_id", "user_id", "event_type", "at")), ["event_id"])
    return L.drained(found.select("event_id", "user_id", "event_type"), spark)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", rows="J8")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = L.latest(L.windows(stream(spark, d), "1 day"), spark, ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL (12 * i) HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) r(i) GROUP BY ALL", rows="J8")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = L.latest(L.windows(stream(spark, d), "24 hours", "12 hours"), spark, ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g
""", rows="J8")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    ending = L.Ending(spark, stream(spark, d))
    out = L.drained(L.sessions(ending.log, "30 minutes"), spark, ending=ending)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT user_id, count(*) AS n, max(ts) AS last, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS lapses FROM events GROUP BY user_id", rows="J3")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Running state of each user: what a stateful replay holds when the log is drained."""
    g = stream(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.count_if(F.col("event_type") == "error").alias("lapses"))
    out = L.latest(g, spark, ["user_id"])
    return out.withColumn("last", F.col("last").cast("timestamp_ntz"))


@query(SRS_SQL + "SELECT uid, k, i AS reps, lapses, last, round(stab, 6) AS stab, round(diff, 6) AS diff FROM z", rows="E6 J3 J4")
def stream_srs(spark: SparkSession, d: str) -> DataFrame:
    """The review state as a stateful stream keeps it; the batch replay is the oracle."""
    log = attempts(stream(spark, d)).withColumn("at", F.col("ts").cast("timestamp"))
    with L.keyed_state(spark):
        out = L.latest(S.replayed(log), spark, ["uid", "k"])
    return out.select("uid", "k", "reps", "lapses", "last", F.round("stab", 6).alias("stab"), F.round("diff", 6).alias("diff"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, max(ts) + INTERVAL 2 HOUR AS sent FROM s GROUP BY user_id, g
""", rows="J7")
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """A user's events, sent together once none has come for two hours; a timer sends the last of them."""
    ending = L.Ending(spark, stream(spark, d))
    with L.keyed_state(spark):
        out = L.drained(S.debounced(ending.log.select("user_id", "at"), "user_id", quiet_s=7200, interval_s=3600), spark, ending=ending)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last", "sent")})


def operations(events: DataFrame) -> DataFrame:
    """The event table as operations on a queue of each user: what is seen is added, a click claims two items, a purchase completes its item."""
    op = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "complete").otherwise("add")
    item = F.get_json_object("props", "$.k")
    worker = F.when(F.col("event_type") == "click", F.concat(F.lit("w"), F.col("event_id") % 3))
    team = F.substring(item, 1, 1)
    return events.select("user_id", "at", F.col("event_id").alias("seq"), op.alias("op"), item.alias("item"), team.alias("team"), worker.alias("worker"), F.lit(2).cast("long").alias("n"))


@query(None, rows="J5")
def stream_lease(spark: SparkSession, d: str) -> DataFrame:
    """Queues with claims that hold for a day: what was served, done, and served again because its claim had run out."""
    ending = L.Ending(spark, stream(spark, d))
    with L.keyed_state(spark):
        out = L.drained(S.leased(operations(ending.log), "user_id", lease_s=86_400), spark, ending=ending)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))
