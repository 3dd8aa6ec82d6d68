"""Every registered query and its DuckDB oracle."""

from __future__ import annotations

from corpusloom.plans import (  # noqa: F401
    aggregations,
    builds,
    clues,
    curation,
    filters,
    joins,
    ordered,
    reports,
    scans,
    sets,
    sql_text,
    store,
    streams,
    strings,
    topics,
    vectors,
)
from corpusloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
