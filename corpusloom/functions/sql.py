"""The library's functions for SQL text: ``register(spark)`` makes them callable from ``spark.sql``.

Functions that built-ins express are SQL functions, whose bodies the optimiser puts into the
query.  Those that need Unicode tables or rules are Arrow UDFs; ``loom_key`` sends only texts
beyond ASCII there.  ``loom_runs`` is a table function over any table: its result type and the
way its input is dealt out and ordered follow from its arguments.

All of them belong to the session; nothing is written to a catalogue.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType, StructType, TimestampNTZType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from corpusloom.functions.answers import judge_udf
from corpusloom.functions.text import match_key_udf

#: name and arguments, what comes back, body
BODIES = (
    (
        "loom_clean(line STRING)", "STRING",
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, r'<[^>]*>', ''), r'\[[\s\S]*', ''), r'\([^)]*\)', ''), r'[ \t\r\n]+', ' '), r'^[ ;,]+|[ ;,]+$', '')",
    ),
    ("loom_ascii_key(name STRING)", "STRING", r"regexp_replace(trim(regexp_replace(lower(name), r'[^a-z0-9_]+', ' ')), r'^(?:the|an|a) +', '')"),
    ("loom_key(name STRING)", "STRING", r"CASE WHEN name RLIKE r'^[\x00-\x7F]*$' THEN loom_ascii_key(name) ELSE loom_unicode_key(CASE WHEN name RLIKE r'[^\x00-\x7F]' THEN name END) END"),
    ("loom_slug(name STRING, sep STRING)", "STRING", r"regexp_replace(regexp_replace(lower(trim(name)), r'[^a-z0-9]+', sep), concat('^', sep, '+|', sep, '+$'), '')"),
    (
        "loom_years(line STRING)", "ARRAY<INT>",
        r"array_distinct(concat(transform(regexp_extract_all(line, r'\b(1[0-9]{3}|20[0-2][0-9])\b', 1), y -> CAST(y AS INT)), transform(regexp_extract_all(line, r'(?i)\b([0-9]{1,4})\s*(?:BCE?|B\.C\.?)\b', 1), y -> -CAST(y AS INT))))",
    ),
    (
        "loom_wilson(hits BIGINT, n BIGINT)", "STRUCT<low: DOUBLE, high: DOUBLE>",
        "CASE WHEN n = 0 THEN named_struct('low', 0.0D, 'high', 1.0D) ELSE named_struct("
        "'low', (hits / n + 1.96D * 1.96D / (2 * n) - 1.96D * sqrt(hits / n * (1 - hits / n) / n + 1.96D * 1.96D / (4.0D * n * n))) / (1 + 1.96D * 1.96D / n), "
        "'high', (hits / n + 1.96D * 1.96D / (2 * n) + 1.96D * sqrt(hits / n * (1 - hits / n) / n + 1.96D * 1.96D / (4.0D * n * n))) / (1 + 1.96D * 1.96D / n)) END",
    ),
)


class Runs:
    """Rows of a key in order, cut where the next comes ``gap`` or more after the last: one row a run, (key, first, last, n).

    ``gap`` is in seconds where ``at`` is a time, else in its own unit.  Rows without a key or
    ``at`` are left out.  A task holds the run at hand and no more.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not all(a.isConstantExpression for a in (key, at, gap)):
            raise ValueError("loom_runs takes a table, and the names of its key and of its order as constants")
        fields = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [a.value for a in (key, at) if a.value not in fields]
        if missing:
            raise ValueError(f"the table has no column {missing[0]}")
        if not isinstance(fields[at.value], (NumericType, TimestampType, TimestampNTZType)):
            raise ValueError(f"{at.value} must be a number or a time")
        schema = StructType().add(key.value, fields[key.value]).add("first", fields[at.value]).add("last", fields[at.value]).add("n", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(at.value)])

    def __init__(self):
        self.run = None

    def eval(self, rows, key: str, at: str, gap: float) -> Iterator[tuple]:
        k, t = rows[key], rows[at]
        if k is None or t is None:
            return
        if self.run is not None:
            apart = t - self.run[2]
            if (apart.total_seconds() if hasattr(apart, "total_seconds") else apart) < gap:
                self.run = (*self.run[:2], t, self.run[3] + 1)
                return
            yield self.run
        self.run = (k, t, t, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self.run


def register(spark: SparkSession) -> None:
    """Make the functions known to this session; again does no harm."""
    spark.udf.register("loom_unicode_key", match_key_udf)
    spark.udf.register("loom_judge", judge_udf)
    for head, returns, body in BODIES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    spark.udtf.register("loom_runs", F.udtf(Runs))
