"""Ordered analytics over an attempt log: rolling metrics, replayed state, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import wilson


def attempts(events: DataFrame) -> DataFrame:
    """The event table as an attempt log: C right, W wrong, D dead; depth in [0, 1]."""
    res = F.when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "error", "W").otherwise("D")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("uid"), "event_type", res.alias("res"), F.least(F.col("value") / 500, F.lit(1.0)).alias("bf"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def rolling_accuracy(log: DataFrame, width: int, *, key: str = "uid", order: tuple[str, ...] = ("ts", "event_id"), right: Column | None = None, least: int = 12) -> DataFrame:
    """Trailing share of right rows with its Wilson band, from the ``min(width, least)``-th row on.

    The width is cut to [2, rows of the key].
    """
    right = (F.col("res") == "C") if right is None else right
    one = Window.partitionBy(key).orderBy(*order)
    frame = one.rowsBetween(-(width - 1), 0)
    n, k = F.count("*").over(frame), F.sum(right.cast("int")).over(frame)
    total = F.count("*").over(Window.partitionBy(key))
    w = F.greatest(F.lit(2), F.least(F.lit(width), total))
    out = log.withColumn("pos", F.row_number().over(one)).withColumn("n", n).withColumn("k", k).withColumn("_w", w)
    lo, hi = wilson(F.col("k"), F.col("n"))
    return out.where(F.col("pos") >= F.least(F.col("_w"), F.lit(least))).withColumn("acc", F.col("k") / F.col("n")).withColumn("lo", lo).withColumn("hi", hi).drop("_w")


def rolling_mean(log: DataFrame, value: Column, when: Column, width: int, least: int, *, key: str = "uid", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Trailing mean of ``value`` over the rows of the window where ``when``; windows with fewer than ``least`` fall out."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width - 1), 0)
    v = F.when(when, value)
    n, mean = F.count(v).over(frame), F.avg(v).over(frame)
    se = F.stddev_samp(v).over(frame) / F.sqrt(F.count(v).over(frame))
    return log.withColumn("n", n).withColumn("mean", mean).withColumn("se", se).where(F.col("n") >= least)


def as_of(points: DataFrame, marks: DataFrame, *, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """For every point the last mark of its key at or before it, by one sorted union."""
    p = points.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_row"), F.lit(None).alias("_v"))
    m = marks.select(F.col(key).alias("_k"), F.col(mark_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(m).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(value))


# Fixed values of the review model: where an item starts, its bounds, and what a review changes.
STABILITY_START, STABILITY_LEAST, STABILITY_MOST = 2.0, 1.0, 500.0
DIFFICULTY_START, DIFFICULTY_LEAST, DIFFICULTY_MOST = 5.0, 1.0, 10.0
PLAIN_GRADE, EASE = 0.4, 0.15
HARDER_WRONG, HARDER_DEAD, FORGET = 1.1, 0.8, 0.35
# Fixed values of scheduling: retention, rest after a review, and how new items are explored.
FORGETTING, TARGET_RETENTION, REST, LAPSE_WEIGHT = 9.0, 0.9, 8, 0.15
LATE_SHARE, PRIOR_ROWS, EXPLORE = 0.5, 5, 0.4


def clocked(log: DataFrame, *, user: str = "uid", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The log with ``clock``, the number of the user's attempt from 0 on, and ``attempts``, how many the user made."""
    w = Window.partitionBy(user)
    return log.withColumn("clock", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("attempts", F.count("*").over(w))


def replay(log: DataFrame, *, keys: tuple[str, ...] = ("uid", "k"), clock: str = "clock") -> DataFrame:
    """State of each key after replaying its reviews in order: stability, difficulty, reps, lapses, last.

    The grade of a right answer is how early it came, 1 - ``bf`` (a half if ``bf`` is null); it
    lowers difficulty and multiplies stability by a growth that falls with difficulty.  Any other
    result raises difficulty, a wrong answer (W) more than none, cuts stability and counts a
    lapse.  The clock is the number of the user's attempt, not the time of day.
    """
    reviews = F.array_sort(F.collect_list(F.struct(F.col(clock).cast("long").alias("c"), "res", F.coalesce("bf", F.lit(0.5)).alias("bf"))))
    start = F.struct(F.lit(STABILITY_START).alias("stab"), F.lit(DIFFICULTY_START).alias("diff"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"), F.lit(0).cast("long").alias("last"))
    within = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))

    def step(s: Column, r: Column) -> Column:
        right = r["res"] == "C"
        grade = within(1 - r["bf"], 0.0, 1.0)
        change = F.when(right, -EASE * (grade - PLAIN_GRADE)).when(r["res"] == "W", HARDER_WRONG).otherwise(HARDER_DEAD)
        diff = within(s["diff"] + change, DIFFICULTY_LEAST, DIFFICULTY_MOST)
        growth = 1 + (11 - diff) / 10 * (PLAIN_GRADE + grade)
        stab = F.when(right, F.least(F.lit(STABILITY_MOST), s["stab"] * growth)).otherwise(F.greatest(F.lit(STABILITY_LEAST), s["stab"] * FORGET))
        return F.struct(stab.alias("stab"), diff.alias("diff"), (s["reps"] + 1).alias("reps"), (s["lapses"] + F.when(right, 0).otherwise(1)).alias("lapses"), r["c"].alias("last"))

    return log.groupBy(*keys).agg(F.aggregate(reviews, start, step).alias("s")).select(*keys, "s.*")


def mix(focus: float = 0.5) -> dict[str, float]:
    """Weights of due, weak and new items; from keeping everything fresh (0) to hammering the weakest (1)."""
    return {"due": 1.0 - 0.6 * focus, "weak": 0.3 + 1.2 * focus, "new": 0.2 + 0.8 * (1 - focus)}


def drill_weight(state: DataFrame, now: Column, *, focus: float = 0.5) -> DataFrame:
    """How much a seen item is due at clock ``now``: what retention lacks to the target, and difficulty with lapses.

    Within ``REST`` attempts of its last review an item weighs next to nothing.
    """
    w = mix(focus)
    elapsed = now - F.col("last")
    keep = 1 / (1 + elapsed / (FORGETTING * F.col("stab")))
    due = F.greatest(F.lit(0.0), TARGET_RETENTION - keep)
    weak = F.col("diff") / 10 * (1 + LAPSE_WEIGHT * F.col("lapses"))
    weight = F.greatest(w["due"] * due + w["weak"] * weak + 1e-3, F.lit(1e-4))
    return state.withColumn("retention", keep).withColumn("weight", F.when(elapsed < REST, 1e-3).otherwise(weight))


def weakness() -> Column:
    """Of an attempt: 1 for a miss, for a right answer half of how late it came."""
    return F.when(F.col("res") == "C", LATE_SHARE * F.coalesce("bf", F.lit(0.5))).otherwise(1.0)


def new_item_weight(log: DataFrame, *, section: str, sub: str, user: str = "uid", focus: float = 0.5) -> DataFrame:
    """(user, section, sub, weight): what an item without reviews weighs, for the sections and subs that the log names.

    The weakness of a section or sub is its mean, drawn to the user's own mean by
    ``PRIOR_ROWS`` attempts; one the user hasn't met has that mean.
    """
    rows = log.select(user, section, sub, weakness().alias("_w"))
    whole = rows.groupBy(user).agg(F.avg("_w").alias("_all"))
    cells = F.broadcast(rows.where(F.col(section).isNotNull() & F.col(sub).isNotNull()).agg(F.sort_array(F.collect_set(F.struct(section, sub))).alias("_cells")))
    out = whole.crossJoin(cells).select(user, "_all", F.explode("_cells").alias("_cell")).select(user, "_all", f"_cell.{section}", f"_cell.{sub}")
    for k, name in ((section, "_s"), (sub, "_t")):
        sums = rows.where(F.col(k).isNotNull()).groupBy(user, k).agg(F.sum("_w").alias(f"{name}_sum"), F.count("*").alias(f"{name}_n"))
        out = out.join(sums, [user, k], "left")
        out = out.withColumn(name, F.coalesce((F.col(f"{name}_sum") + PRIOR_ROWS * F.col("_all")) / (F.col(f"{name}_n") + PRIOR_ROWS), "_all"))
    return out.select(user, section, sub, (mix(focus)["new"] * (0.5 + F.col("_s") * F.col("_t")) + EXPLORE).alias("weight"))


def suffix_numbers(rows: DataFrame, base: str, order: list[Column], out: str) -> DataFrame:
    """The n-th row with a base gets ``_n`` behind it, from the second on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), n.cast("string"))))


def upper_median(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row at place n // 2 (from 0) of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_p", F.row_number().over(w)).withColumn("_n", n).where("_p = floor(_n / 2) + 1").drop("_p", "_n")
