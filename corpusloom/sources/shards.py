"""Shards of a table by key: written once, and read only where keys that are asked for lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys at most whose shards are listed in a read's plan.
MOST_LISTED = 10_000


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key, the same in every run."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write_shards(rows: DataFrame, key: str, path: str, shards: int) -> None:
    """One folder for each shard, its rows sorted by key; a shard's files stand only once all are written."""
    placed = rows.withColumn("shard", shard_of(F.col(key), shards))
    placed.repartition("shard").sortWithinPartitions("shard", key).write.mode("errorifexists").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, key: str, asked: DataFrame | Sequence, shards: int) -> DataFrame:
    """The rows of the keys that are asked for; a key that isn't there gives none.

    Shards of a bounded list of keys are named in the plan, those of a frame are found by its join.
    """
    rows = spark.read.parquet(path)
    if isinstance(asked, DataFrame):
        keys = asked.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("shard", shard_of(F.col(key), shards))
        return rows.join(keys, ["shard", key], "left_semi").drop("shard")
    if len(asked) > MOST_LISTED:
        raise ValueError(f"over {MOST_LISTED} keys are asked for by a frame")
    kind = rows.schema[key].dataType
    listed = spark.createDataFrame([(k,) for k in asked], f"`{key}` {kind.simpleString()}").select(shard_of(F.col(key), shards).alias("s")).distinct()
    named = [r.s for r in listed.collect()]
    return rows.where(F.col("shard").isin(*named) & F.col(key).isin(*asked)).drop("shard")
