"""Queries as SQL text over the library's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import sql
from corpusloom.plans.joins import KEY_SQL
from corpusloom.plans.registry import query
from corpusloom.sources.tables import spread, table


@query(f"""
SELECT p_partkey, {KEY_SQL.format('p_name')} AS key, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, p_brand || ' x' AS display,
 CASE WHEN p_size < 20 THEN 'accept' WHEN p_size < 35 THEN 'prompt' ELSE 'reject' END AS verdict, CAST(1000 + p_size AS INTEGER) AS first_year FROM part
""", rows="K5")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Keys, slugs, display forms, verdicts on given answers and years, all called from SQL."""
    sql.register(spark)
    return spark.sql("""
        WITH answers AS (
          SELECT *, concat('<b><u>', p_name, '</u></b> [or ', p_size, ' ', p_brand, '; prompt on ', substring_index(p_name, ' ', 1), ']') AS line,
            CASE WHEN p_size < 20 THEN p_name WHEN p_size < 35 THEN substring_index(p_name, ' ', 1) ELSE 'qqqqqq' END AS given FROM {part}
        )
        SELECT p_partkey, loom_key(p_name) AS key, loom_slug(p_type, '-') AS slug, loom_clean(concat('<i>', p_brand, '</i> (', p_name, ') x; [', p_type, ']')) AS display,
          loom_judge(line, given).directive AS verdict, loom_years(concat('made in ', 1000 + p_size, ' or 44 BC'))[0] AS first_year
        FROM answers
    """, part=spread(table(spark, d, "part"), "p_name", "p_brand", "p_size"))  # fmt: skip


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, g
""", rows="K5")
def sql_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events by a table function, which asks for its input by user and in order of time."""
    sql.register(spark)
    return spark.sql("SELECT * FROM loom_runs(TABLE(SELECT user_id, ts FROM {events}), key => 'user_id', at => 'ts', gap => 21600)", events=table(spark, d, "events"))
