"""The library's functions in SQL text."""

import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom.functions import numeric, sql, text
from corpusloom.functions.answers import judge

NAMES = ["The Odyssey", "a  Bee; Sea", "Café—Noir", "Łódź_1", "", None, "AN ant", "Æther ß", "x [y]"]
LINES = ["<b>An</b> Ode (to joy) [or x]", " ;a, ", "in 1999, 2029, 2030 and 44 BC; 1999", "500 b.c. [a\nb]", "", None, "tab\tand\nline"]


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


def test_scalars_are_the_column_functions(session):
    df = session.createDataFrame([(n,) for n in NAMES], "name string")
    got = df.select(F.expr("loom_key(name)").alias("key"), F.expr("loom_slug(name, '-')").alias("slug"), text.slug(F.col("name")).alias("want")).collect()
    assert [r.key for r in got] == [text.match_key(n) for n in NAMES] and all(r.slug == r.want for r in got)
    df = session.createDataFrame([(n,) for n in LINES], "line string")
    got = df.select(F.expr("loom_clean(line)").alias("a"), text.clean_answerline(F.col("line")).alias("b"), F.expr("loom_years(line)").alias("c"), text.years(F.col("line")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and got[2].c == [1999, 2029, -44]
    df = session.createDataFrame([(0, 0), (0, 5), (3, 5), (5, 5)], "k long, n long")
    low, high = numeric.wilson(F.col("k"), F.col("n"))
    for r in df.select(F.expr("loom_wilson(k, n)").alias("w"), low.alias("low"), high.alias("high")).collect():
        assert abs(r.w.low - r.low) < 1e-12 and abs(r.w.high - r.high) < 1e-12


def test_ascii_names_stay_out_of_python(session):
    df = session.createDataFrame([("The Bee",), ("é",)], "name string").selectExpr("loom_key(name) AS key")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "match_key_udf(CASE WHEN" in plan or "loom_unicode_key(CASE WHEN" in plan  # other texts alone are sent, the rest as nulls
    assert [r.key for r in df.collect()] == ["bee", "e"]


def test_keys_of_any_text(session):
    names = [*NAMES, "a\tb\x1fc", "__A__", "the", "an  Ox", "A1b2"]
    df = session.createDataFrame([(n,) for n in names], "name string")
    got = df.select(text.key("name").alias("key"), text.answer_drill_key("name").alias("drill")).collect()
    assert [(r.key, r.drill) for r in got] == [(text.match_key(n), text.drill_key(n)) for n in names]


def test_judge_in_sql(session):
    line = "<b><u>Moby Dick</u></b> [prompt on whale]"
    for given in ("moby dick", "whale", "cow", None):
        found = session.sql("SELECT loom_judge(:line, CAST(:given AS STRING)) AS j", args={"line": line, "given": given}).first().j
        assert (found.directive, found.prompt) == judge(line, given)


def test_runs_follow_the_type_of_their_table(session):
    rows = [("a", 1), ("a", 3), ("a", 9), ("b", 2), (None, 1), ("b", None), ("a", 2)]
    session.createDataFrame(rows, "who string, step int").repartition(3).createOrReplaceTempView("steps")
    found = session.sql("SELECT * FROM loom_runs(TABLE(steps), key => 'who', at => 'step', gap => 3)")
    assert found.schema.simpleString() == "struct<who:string,first:int,last:int,n:bigint>"
    assert sorted(map(tuple, found.collect())) == [("a", 1, 3, 3), ("a", 9, 9, 1), ("b", 2, 2, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "Sort [" in plan  # the input is dealt out by key and sorted
    t = datetime.datetime(2024, 1, 1)
    session.createDataFrame([(7, t), (7, t + datetime.timedelta(seconds=59)), (7, t + datetime.timedelta(seconds=119))], "id long, at timestamp").createOrReplaceTempView("times")
    found = session.sql("SELECT id, n FROM loom_runs(TABLE(times), key => 'id', at => 'at', gap => 60)").collect()
    assert sorted(map(tuple, found)) == [(7, 1), (7, 2)]


def test_runs_say_what_is_wrong(session):
    session.range(3).createOrReplaceTempView("three")
    with pytest.raises(AnalysisException, match="no column nothing"):
        session.sql("SELECT * FROM loom_runs(TABLE(three), key => 'nothing', at => 'id', gap => 1)")
