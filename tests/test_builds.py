"""Shards, staged builds and dates."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates
from corpusloom.operators.stages import Build, Stage
from corpusloom.sources import shards


def test_shards_are_read_where_keys_lie(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 40}", i) for i in range(200)] + [(None, 900)], "k string, v int")
    at = str(tmp_path / "s")
    shards.write_shards(rows, "k", at, 8)
    some = shards.read_shards(spark, at, "k", ["k3", "k17", "nowhere"], 8)
    assert sorted(r.v for r in some.collect()) == sorted(i for i in range(200) if i % 40 in (3, 17)) and some.columns == ["k", "v"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "In(k," in plan
    asked = spark.createDataFrame([("k3",), ("k3",), (None,), ("gone",)], "k string")
    assert sorted(r.v for r in shards.read_shards(spark, at, "k", asked, 8).collect()) == [i for i in range(200) if i % 40 == 3]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        shards.write_shards(rows, "k", at, 8)
    with pytest.raises(ValueError):
        shards.read_shards(spark, at, "k", ["x"] * 10_001, 8)


def test_stages_run_by_need(spark):
    ran = []

    def stage(name, *needs):
        def run(*frames):
            ran.append(name)
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f)
            return out.withColumn("path", F.concat("path", F.lit(f">{name}")))

        return Stage(name, needs, run)

    build = Build([stage("d", "b", "c"), stage("c", "a"), stage("b", "a"), stage("a", "raw"), stage("e", "d")])
    raw = spark.createDataFrame([("r",)], "path string")
    out = build(spark, ["d"], {"raw": raw})
    assert ran == ["a", "b", "c", "d"] and sorted(r.path for r in out["d"].collect()) == ["r>a>b>d", "r>a>c>d"]
    ran.clear()
    # what is given isn't made, nor what only that needed
    out = build(spark, ["d", "b"], {"a": raw})
    assert ran == ["b", "c", "d"] and [r.path for r in out["b"].collect()] == ["r>b"]
    with pytest.raises(ValueError, match="a needs raw"):
        build.order(["d"], [])
    with pytest.raises(ValueError, match="need each other: x < y < x"):
        Build([stage("x", "y"), stage("y", "x")]).order(["x"], [])
    with pytest.raises(ValueError, match="one name"):
        Build([stage("x", "y"), stage("x", "z")])


def test_bounds_of_times(spark):
    t = datetime.datetime(2024, 2, 28, 23, 50)
    rows = [(t, t + datetime.timedelta(seconds=s)) for s in (0, 1800, 1800.5, 86_400, 2 * 86_400.0)] + [(None, t)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    a, b = F.col("a"), F.col("b")
    got = df.select(dates.day_stamp(b).alias("d"), dates.lease_is_over(a, b).alias("o"), dates.still_valid(a, b, 1).alias("v"), dates.days_apart(a, b).alias("n")).collect()
    assert [r.o for r in got] == [False, False, True, True, True, False] and [r.v for r in got] == [True, True, True, True, False, False]
    assert [r.n for r in got] == [0, 1, 1, 1, 2, None] and [r.d for r in got][:2] == ["2024-02-28", "2024-02-29"]
