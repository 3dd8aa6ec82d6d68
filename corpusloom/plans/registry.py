"""Registers queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Rows of the survey that each query covers.
ROWS: dict[str, list[str]] = {}


def query(sql: str | None = None, rows: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ROWS[f.__name__] = rows.split()
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
