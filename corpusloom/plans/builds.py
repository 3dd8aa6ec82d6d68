"""Queries over shards, staged builds and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dates as D
from corpusloom.operators.stages import Build, Stage
from corpusloom.plans.registry import query
from corpusloom.sources import shards as S
from corpusloom.sources.tables import shared_folder, table


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", rows="A19 A25")
def shard_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts in shards by key, of which only those are read that hold what lines ask for."""
    at = shared_folder(spark, "shards")
    S.write_shards(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", at, 16)
    asked = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return S.read_shards(spark, at, "p_partkey", asked, 16)


def topics(part: DataFrame) -> DataFrame:
    return part.where("p_size > 10").select(F.col("p_partkey").alias("topic"), F.col("p_brand").alias("unit"))


def mentions(lineitem: DataFrame, topics: DataFrame) -> DataFrame:
    return lineitem.join(topics, F.col("l_partkey") == F.col("topic")).groupBy("topic", "unit").agg(F.count("*").alias("n"))


def coverage(topics: DataFrame, mentions: DataFrame) -> DataFrame:
    have = topics.join(mentions.where("n >= 2").select("topic", F.lit(1).alias("hit")), "topic", "left")
    return have.groupBy("unit").agg(F.count("*").alias("n_topics"), F.count("hit").alias("n_covered"))


#: Stands in no order; what each needs says when it runs.
REPORTS = Build([Stage("coverage", ("topics", "mentions"), coverage), Stage("mentions", ("lineitem", "topics"), mentions), Stage("topics", ("part",), topics)])


@query("""
WITH t AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 10), m AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2)
SELECT p_brand AS unit, count(*) AS n_topics, count(l_partkey) AS n_covered FROM t LEFT JOIN m ON p_partkey = l_partkey GROUP BY p_brand
""", rows="K4")
def staged_build(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by unit as the last of three stages, two of which share the first one's frame."""
    return REPORTS(spark, ["coverage"], {n: table(spark, d, n) for n in ("part", "lineitem")})["coverage"]


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(now) - epoch_us(ts) > 1800000000 AS over, epoch_us(now) - epoch_us(ts) <= 604800000000 AS valid, CAST(date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) AS INTEGER) AS days FROM events, n
""", rows="I6")
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Days, leases of half an hour and tokens of a week, as of the newest event."""
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    rows = events.crossJoin(F.broadcast(now))
    at, to = F.col("ts"), F.col("now")
    return rows.select("event_id", D.day_stamp(at).alias("day"), D.lease_is_over(at, to).alias("over"), D.still_valid(at, to, 7).alias("valid"), D.days_apart(at, to).alias("days"))
