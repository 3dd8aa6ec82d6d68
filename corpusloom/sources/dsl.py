"""Outline text: ``# section``, ``> blurb``, ``A = B -> Topic | note`` and nested ``- `` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(lines: DataFrame, *, key: str, pos: str, text: str) -> DataFrame:
    """(key, pos, section, answerline, variants, topic, note, nested, error) of every entry line.

    Errors: a line before any section (orphan), an entry without a name (missing),
    and a name that the section already holds (duplicate).
    """
    line = F.trim(F.col(text))
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.startswith(line, F.lit("# ")), F.trim(F.substring(line, 3, 10_000))), ignorenulls=True).over(w)
    rows = lines.withColumn("line", line).withColumn("section", section).where(
        (F.col("line") != "") & ~F.startswith("line", F.lit("# ")) & ~F.startswith("line", F.lit(">"))
    )
    body = F.regexp_replace("line", "^- ", "")
    note = F.when(F.contains(body, F.lit("|")), F.trim(F.regexp_replace(body, r"^[^|]*\|", "")))
    left = F.trim(F.regexp_replace(body, r"\|.*$", ""))
    topic = F.when(F.contains(left, F.lit("->")), F.trim(F.regexp_replace(left, r"^.*?->", "")))
    names = F.transform(F.split(F.regexp_replace(left, r"->.*$", ""), "="), lambda x: F.trim(x))
    out = rows.select(
        key, pos, "section", F.get(names, F.lit(0)).alias("answerline"), F.slice(names, F.lit(2), F.greatest(F.lit(0), F.size(names) - 1)).alias("variants"),
        topic.alias("topic"), note.alias("note"), F.startswith("line", F.lit("- ")).alias("nested"),
    )
    again = F.row_number().over(Window.partitionBy(key, "section", F.lower("answerline")).orderBy(pos)) > 1
    error = F.when(F.col("section").isNull(), "orphan").when(F.col("answerline") == "", "missing").when(again, "duplicate")
    return out.withColumn("error", error)


def _numbered_sections(lines: DataFrame, key: str, pos: str, text: str) -> tuple[DataFrame, Column]:
    """Lines with ``_line``, ``section`` (0 before the first heading) and ``kind``: heading, blurb or entry."""
    line = F.trim(F.col(text))
    kind = F.when(F.startswith(line, F.lit("#")), "heading").when(F.startswith(line, F.lit(">")), "blurb").otherwise("entry")
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_line", line).withColumn("kind", kind)
    return rows.withColumn("section", F.count(F.when(F.col("kind") == "heading", 1)).over(w)), w


def plan(lines: DataFrame, *, key: str, pos: str, text: str) -> DataFrame:
    """(key, section, name, blurb) of a plan: headings with a name, each with its last blurb line, or none."""
    rows, _ = _numbered_sections(lines, key, pos, text)
    name = F.max(F.when(F.col("kind") == "heading", F.trim(F.regexp_replace("_line", "^#+", ""))))
    blurb = F.max_by(F.when(F.col("kind") == "blurb", F.trim(F.regexp_replace("_line", "^>+", ""))), F.when(F.col("kind") == "blurb", F.col(pos)))
    return rows.where("section > 0").groupBy(key, "section").agg(name.alias("name"), F.coalesce(blurb, F.lit("")).alias("blurb")).where("name <> ''")


def entry_blocks(lines: DataFrame, *, key: str, pos: str, text: str) -> DataFrame:
    """(key, section, block, pos, n_lines, block_text): entries with the nested "- " lines below them.

    A nested line that no entry of its section precedes is an entry; lines before the
    first heading and blank ones are left out.
    """
    rows, _ = _numbered_sections(lines, key, pos, text)
    rows = rows.where("section > 0 and kind = 'entry' and _line <> ''")
    w = Window.partitionBy(key, "section").orderBy(pos)
    opens = (F.row_number().over(w) == 1) | ~F.startswith("_line", F.lit("- "))
    rows = rows.withColumn("opens", opens).withColumn("block", F.count(F.when(F.col("opens"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(text).alias("raw"))))
    found = rows.groupBy(key, "section", "block").agg(inside.alias("b"))
    return found.select(key, "section", "block", F.get("b", F.lit(0))["pos"].alias(pos), F.size("b").alias("n_lines"), F.array_join(F.transform("b", lambda x: x["raw"]), "\n").alias("block_text"))
