"""Topic documents and their queues: predicates, labels, nested entries, packets, summaries, pluggable breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What in a work's name says that it is a grouping, what a bonus part is worth, and who is queued again how.
GROUPINGS = ("General", "Biographical", "Other Works", "Other ")
PART_VALUES = (10, 10, 10)
DIFFICULTIES, MIN_YEAR = "7,8,9,10", 2012
TIERS = ("definite", "likely")
MODES = ("all", "review", "ok")


def is_real_work(name: Column) -> Column:
    """Whether a work's name is that of a work, not of a grouping; a missing name is no grouping."""
    c = F.coalesce(name, F.lit(""))
    grouping = F.lit(False)
    for part in GROUPINGS:
        grouping = grouping | F.contains(c, F.lit(part))
    return ~grouping


def is_place(rows: DataFrame, name: str, places: DataFrame, place: str, out: str = "is_place") -> DataFrame:
    """Mark the rows whose name is that of a place, as it is or without "The " in front."""
    known = places.select(F.col(place).alias("_place")).where(F.col(place).isNotNull()).distinct()
    keyed = rows.withColumn("_bare", F.regexp_replace(name, "^The ", ""))
    hit = keyed.join(known.withColumn("_a", F.lit(True)), F.col(name) == F.col("_place"), "left").drop("_place")
    hit = hit.join(known.withColumn("_b", F.lit(True)), F.col("_bare") == F.col("_place"), "left").drop("_place")
    return hit.withColumn(out, F.coalesce(F.col("_a"), F.col("_b"), F.lit(False))).drop("_bare", "_a", "_b")


def name_holds(name: Column, needle: str) -> Column:
    """Names that hold ``needle``, in any case; an empty one is in all."""
    return F.contains(F.lower(name), F.lit(needle.lower()))


def in_review(flagged: Column, mode: str) -> Column:
    """What a review shows: everything, what is flagged, or what isn't; a missing flag is none."""
    flag = F.coalesce(flagged, F.lit(False))
    return {"all": F.lit(True), "review": flag, "ok": ~flag}[mode]


def quoted(c: Column) -> Column:
    """A pattern for the text of ``c`` as it stands."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def highlighted(text: Column, query: Column) -> Column:
    """The text with each place of ``query``, in any case, in mark tags, but not inside other tags; as it is without a query."""
    found = F.regexp_replace(text, F.concat(F.lit("(?iu)("), quoted(query), F.lit(")(?![^<]*>)")), F.lit("<mark>$1</mark>"))
    return F.when(F.coalesce(query, F.lit("")) == "", text).otherwise(found)


def tab_label(query: Column, difficulties: Column, mentions: Column) -> Column:
    """A query, the range of its difficulties, and whether mentions were asked for."""
    some = F.coalesce(F.size(difficulties) > 0, F.lit(False))
    span = F.when(some, F.concat(F.lit(" (d"), F.array_min(difficulties).cast("string"), F.lit("–"), F.array_max(difficulties).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.coalesce(query, F.lit("?")), span, F.when(F.coalesce(mentions, F.lit(False)), " mentions").otherwise(""))


def placed_entries(overviews: DataFrame, key: str, sections: str = "sections") -> DataFrame:
    """(key, section, pos, depth, answerline, variants): every entry of nested overviews in order, each before its works.

    ``sections`` is an array of (name, entries of (answerline, variants, works of the same)).
    """
    section = overviews.select(key, F.posexplode(sections).alias("_s", "_section"))
    entry = section.select(key, "_s", F.col("_section.name").alias("section"), F.posexplode("_section.entries").alias("_e", "_entry"))
    flat = lambda e: F.struct(e["answerline"].alias("answerline"), e["variants"].alias("variants"))
    every = F.concat(F.array(flat(F.col("_entry"))), F.coalesce(F.transform("_entry.works", flat), F.array()))
    rows = entry.select(key, "_s", "section", "_e", F.posexplode(every).alias("_w", "_one"))
    order = Window.partitionBy(key).orderBy("_s", "_e", "_w")
    return rows.select(key, "section", (F.row_number().over(order) - 1).alias("pos"), F.when(F.col("_w") > 0, 1).otherwise(0).alias("depth"), "_one.answerline", "_one.variants")


def packets(questions: DataFrame, *, packet: str, number: str, kind: str, text: str, parts: str, values: str) -> DataFrame:
    """(packet, tossups, bonuses): a packet's questions in the order of their numbers.

    A bonus without values, or whose values can't be read, has ten for each of three parts.
    A packet is a page of questions, so one row holds it.
    """
    worth = F.coalesce(F.from_json(values, "array<int>"), F.array(*map(F.lit, PART_VALUES)))
    bonus = F.col(kind) == "bonus"
    one = lambda *cols: F.struct(F.col(number).alias("number"), *cols)
    ordered = lambda when, item: F.array_sort(F.collect_list(F.when(when, item)))
    return questions.groupBy(packet).agg(
        ordered(~bonus, one(F.col(text).alias("question"))).alias("tossups"),
        ordered(bonus, one(F.col(text).alias("leadin"), F.col(parts).alias("parts"), worth.alias("values"))).alias("bonuses"),
    )


def queue_summary(queues: Mapping[str, DataFrame], category: str) -> DataFrame:
    """(queue, category, n): how many of each category wait in each queue, and a row for each queue's total (category null).

    Items without a category count as Unknown.
    """
    every = None
    for name, rows in queues.items():
        own = rows.select(F.lit(name).alias("queue"), F.coalesce(F.col(category), F.lit("Unknown")).alias("category"))
        every = own if every is None else every.unionByName(own)
    counted = every.groupBy("queue", "category").agg(F.count("*").alias("n"))
    total = counted.groupBy("queue").agg(F.sum("n").alias("n")).select("queue", F.lit(None).cast("string").alias("category"), "n")
    return counted.unionByName(total)


def redo_tier(works: Column, questions: Column) -> Column:
    """How sure it is that a topic was analysed too thinly: few works from many questions."""
    return F.when((works <= 2) & (questions >= 15), "definite").when((works <= 3) & (questions >= 20), "likely").otherwise("maybe")


def enqueued(queue: DataFrame, candidates: DataFrame, *, order: Sequence[Column], tiers: Sequence[str] = TIERS) -> DataFrame:
    """The queue, and behind it the candidates (topic, category, works, questions) of some tiers that it doesn't hold in any case.

    Of candidates with the same topic the first by ``order`` comes in.
    """
    tier = redo_tier(F.col("works"), F.col("questions"))
    held = queue.select(F.lower("topic").alias("_key")).distinct()
    w = Window.partitionBy("_key").orderBy(*order)
    new = candidates.withColumn("tier", tier).where(F.col("tier").isin(*tiers)).withColumn("_key", F.lower("topic"))
    new = new.join(held, "_key", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    reason = F.format_string("redo: %d works from %d questions (tier=%s)", F.col("works"), F.col("questions"), F.col("tier"))
    new = new.select("topic", "category", F.lit(DIFFICULTIES).alias("difficulties"), F.lit(MIN_YEAR).alias("min_year"), reason.alias("reason"), "tier")
    return queue.unionByName(new, allowMissingColumns=True)


class Breakdown:
    """Metrics and dimensions by name: what a breakdown of a log can show, open to more."""

    def __init__(self, dimensions: Mapping[str, Column], metrics: Mapping[str, Column]):
        self.dimensions, self.metrics = dict(dimensions), dict(metrics)

    def with_(self, *, dimensions: Mapping[str, Column] | None = None, metrics: Mapping[str, Column] | None = None) -> Breakdown:
        return Breakdown(self.dimensions | dict(dimensions or {}), self.metrics | dict(metrics or {}))

    def __call__(self, log: DataFrame, by: Sequence[str], show: Sequence[str]) -> DataFrame:
        """The metrics of each combination of the dimensions, in the table's own order; rows that lack one, or have it empty, fall out."""
        unknown = [x for x in by if x not in self.dimensions] + [x for x in show if x not in self.metrics]
        if unknown or not show:
            raise ValueError(f"no such dimension or metric: {', '.join(unknown) or 'none is shown'}")
        names = [d for d in self.dimensions if d in by]
        # the metrics name columns of the log, so dimensions stand beside them under names of their own
        keyed = log.withColumns({f"_dim_{d}": self.dimensions[d] for d in names})
        for d in names:
            keyed = keyed.where(F.col(f"_dim_{d}").isNotNull() & (F.col(f"_dim_{d}").cast("string") != ""))
        shown = keyed.groupBy(*(f"_dim_{d}" for d in names)).agg(*(self.metrics[m].alias(m) for m in show))
        return shown.select(*(F.col(f"_dim_{d}").alias(d) for d in names), *show)
