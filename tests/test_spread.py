"""Long work on a small file is dealt to all cores; equal work in a batch is done once."""

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from corpusloom.functions import answers
from corpusloom.operators import match


@pytest.mark.parametrize("name", ["sql_functions", "answer_judge", "reveal_units", "clue_sentences", "clue_extraction"])
def test_rows_of_one_file_go_to_many_tasks(spark, sf, name):
    found = queries()[name](spark, sf)
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 4


def test_equal_questions_are_judged_once(monkeypatch):
    asked = []
    real = answers.judge
    monkeypatch.setattr(answers, "judge", lambda *a: asked.append(a) or real(*a))
    line, given = ["<u>Red Sea</u> [prompt on Red]"] * 4 + [None], ["Red Sea", "Red", "Red Sea", None, "x"]
    got = answers.judge_udf.func(pd.Series(line), pd.Series(given, dtype=object))
    assert got["directive"].tolist() == ["accept", "prompt", "accept", "reject", "reject"]
    assert len(asked) == 4


def test_pairs_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(match, "PAIRED_ROWS", 100)
    rows = [(n // 5, (n * n) % 23) for n in range(4000)] + [(None, 1), (None, 2), (7, None)]
    df = spark.createDataFrame(rows, "g long, s long")
    found = match.co_occurrence(df, "g", "s")
    groups: dict = {}
    for g, x in rows:
        if g is not None and x is not None:
            groups.setdefault(g, set()).add(x)
    want = Counter((a, b) for found in groups.values() for a in found for b in found if a < b)
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == dict(want)
    assert "hashpartitioning(g#" in (plan := found._jdf.queryExecution().toString()) and ", 41)" in plan
