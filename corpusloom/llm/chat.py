"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, everybody else as a named user, and system turns as
they are.  The result has one row per conversation, perspective and turn, so a
conversation of any length is never gathered into one row or task; ordered by
``turn`` (ties by ``position_key``) the ``rendered`` pieces of a perspective
concatenate to its training text.  ``mask_start`` and ``mask_end`` bound the
characters of ``rendered`` that carry loss: the content of the assistant's
turns with its end mark, nothing elsewhere (both 0).

Only the distinct (conversation, speaker) pairs are aggregated, with partial
sums before the shuffle; turns meet them in a sort-merge join whose skewed
partitions adaptive execution splits, so that one hot conversation spreads.

Defined cases: a null role is the speaker ``unknown``; null text is empty; a null
conversation id is a conversation of its own; repeated rows are rendered each
time; a conversation of system turns alone has no participant and no rows;
template marks inside texts are broken up by a space so that they can't end a
turn; characters that a name can't hold become "_", and such a name ends in a
hash of the speaker, so two speakers never share one; texts of any length are
rendered whole; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, name, rendered, n_chars, mask_start, mask_end, position_key)."""
    t = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        _safe(F.col(text_col).cast("string")).alias("content"),
    )
    people = (
        t.where(F.col("speaker") != system)
        .groupBy(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective"))
        .agg(F.count("*").alias("own_turns"))
    )
    role = (
        F.when(F.col("speaker") == system, F.lit("system"))
        .when(F.col("speaker") == F.col("perspective"), F.lit("assistant"))
        .otherwise(F.lit("user"))
    )
    plain = F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_")
    # speakers whose names differ only in replaced marks stay apart
    name = F.when(plain == F.col("speaker"), plain).otherwise(F.concat(plain, F.lit("_"), F.substring(F.md5(F.col("speaker").cast("binary")), 1, 8)))
    head = F.concat(
        F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("name"))).otherwise(F.lit("")), F.lit("\n")
    )
    own = F.col("role") == "assistant"
    return (
        t.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv")))
        .withColumn("role", role)
        .withColumn("name", name)
        .withColumn("head", head)
        .withColumn("rendered", F.concat("head", "content", F.lit(CLOSE + "\n")))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "role",
            "name",
            "rendered",
            F.length("rendered").cast("long").alias("n_chars"),
            F.when(own, F.length("head")).otherwise(0).cast("long").alias("mask_start"),
            F.when(own, F.length("rendered") - 1).otherwise(0).cast("long").alias("mask_end"),
            F.md5(F.concat_ws("\u0001", "speaker", "content").cast("binary")).alias("position_key"),
        )
    )


ROTATE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS p_conv, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') || CASE WHEN regexp_matches(speaker, '[^A-Za-z0-9_-]') THEN '_' || substr(md5(speaker), 1, 8) ELSE '' END AS name
  FROM t JOIN people ON conv_id IS NOT DISTINCT FROM p_conv
), h AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM r
), o AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM h
)
SELECT conv_id, perspective, turn, speaker, role, name, rendered,
       CAST(length(rendered) AS BIGINT) AS n_chars,
       CAST(CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN length(rendered) - 1 ELSE 0 END AS BIGINT) AS mask_end,
       md5(speaker || chr(1) || content) AS position_key
FROM o
"""
