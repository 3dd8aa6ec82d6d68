"""Clues of questions: sentences of tossups, parts of bonuses, keys of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def tossup_clues(questions: DataFrame, *, id_col: str, text_col: str, html_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, pos, text, in_power, is_giveaway, carried columns): one row for each sentence, without reading guides."""
    rows = questions.select(id_col, *carry, F.col(html_col).alias("_html"), F.posexplode(X.sentences_udf(X.without_guides(F.coalesce(text_col, F.lit(""))))).alias("pos", "text"))
    power = X.in_power(F.col("text"), F.coalesce("_html", F.lit("")))
    return rows.select(id_col, "pos", "text", power.alias("in_power"), X.is_giveaway(F.col("text")).alias("is_giveaway"), *carry)


def bonus_clues(bonuses: DataFrame, *, id_col: str, leadin_col: str, parts_col: str, answers_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, part_index, text, part_answer, leadin, carried columns): one row for each part that has an answer."""
    both = F.slice(F.arrays_zip(F.col(parts_col).alias("p"), F.col(answers_col).alias("a")), F.lit(1), F.least(F.size(parts_col), F.size(answers_col)))
    rows = bonuses.select(id_col, F.col(leadin_col).alias("leadin"), *carry, F.posexplode(both).alias("part_index", "z"))
    return rows.select(id_col, "part_index", F.col("z.p").alias("text"), F.col("z.a").alias("part_answer"), "leadin", *carry)


def alternative_keys(answers: DataFrame, *, id_col: str, answer_col: str) -> DataFrame:
    """(id, place, key): match keys of an answer line, the primary one first, each key once."""
    rows = answers.select(id_col, F.posexplode(X.alternatives(F.col(answer_col))).alias("at", "name"))
    keys = rows.select(id_col, "at", X.key("name").alias("key")).where("key <> ''")
    first = keys.groupBy(id_col, "key").agg(F.min("at").alias("at"))
    return first.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("at")) - 1).cast("int").alias("place"), "key")
