"""Every query of the library runs; those with an oracle give its rows."""

import math

import pytest

from corpusloom import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return None if v is None else str(v)


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert mine == want


def test_plans_stay_out_of_python_and_push_down(spark, sf):
    plan = QUERIES["taxonomy_slice"](spark, sf)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters: [" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_queries_name_the_survey_rows_that_they_cover():
    import re

    from corpusloom.plans.registry import ROWS

    assert set(ROWS) == set(QUERIES) and all(rows and all(re.fullmatch("[A-K][0-9]+", r) for r in rows) for rows in ROWS.values())
