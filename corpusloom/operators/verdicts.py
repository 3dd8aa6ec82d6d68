"""Small verdicts over columns: instructions, file names, first words heard, what a player missed, votes on sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import reveal

# How instructions to players begin or what they hold, and below which length they count.
INSTRUCTIONS = (
    r"(?i)^\s*(note to (players|moderator|teams)|description acceptable|two answers required|name the|answer the following)"
    r"|(composer and (genre|type|piece) .{0,20}required)"
)
SHORT = 120
# Parts of names that don't tell an artist, and file names that tell nothing.
PARTICLES = ("the", "von", "van", "de", "del", "di", "el", "der", "den")
GENERIC = (
    "thumbnail", "photo", "image", "picture", "file", "untitled", "img_", "dsc_", "screenshot", "panorama", "cute", "vacation", "nature", "abstract_design",
)
# Words that are heard where the start of another was cut off, and how far apart two words are strangers.
FUNCTION_WORDS = ("a", "an", "and", "the", "in", "of", "to", "is", "it", "its", "on", "for", "as", "at", "but", "or", "was", "he", "she", "they", "that")
STRANGE = 0.6
# Sentences before the last heard that are asked for, and what a vote needs to win.
ASKED_BACK = 3
LEAST_WEIGHT, LEAST_MARGIN = 3.0, 1.5


def is_boilerplate(text: Column, pattern: str = INSTRUCTIONS, most: int = SHORT) -> Column:
    """Whether a short text is an instruction."""
    return text.rlike(pattern) & (F.length(text) < most)


def filename_verdict(filename: Column, artist: Column) -> Column:
    """pass if the name of the artist is in a file's name, fail if another's is or the name is generic, else pending."""
    low, name = F.lower(filename), F.lower(artist)
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: (F.length(p) > 2) & ~p.isin(*PARTICLES))
    named = F.exists(F.array_append(parts, F.replace(name, F.lit(" "), F.lit("_"))), lambda p: F.contains(low, p))
    other = low.rlike("^[a-z]+_[a-z]+_-_") | F.contains(low, F.lit("_by_"))
    generic = F.exists(F.array(*map(F.lit, GENERIC)), lambda g: F.contains(low, g))
    return F.when(named, "pass").when(other | generic, "fail").otherwise("pending")


def letters_of(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def first_content_word(text: Column) -> Column:
    """The first word that has a letter or digit, as these alone; empty without one."""
    words = F.filter(F.transform(reveal.words(text), letters_of), lambda w: w != "")
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def first_word_ok(heard: Column, want: Column) -> Column:
    """Whether a first word was spoken as it should be; only clear defects fail.

    These are silence, a content word that came out as a function word, and a longer word
    that came out as one that is far from it.  Words that begin alike pass.
    """
    h, w = letters_of(heard), letters_of(want)
    swapped = (F.length(w) >= 3) & h.isin(*FUNCTION_WORDS)
    strange = (F.length(w) >= 4) & (F.length(h) >= 2) & (F.levenshtein(h, w) > STRANGE * F.length(w))
    return F.when(w == "", True).when(h == "", False).when((h == w) | (F.substring(h, 1, 1) == F.substring(w, 1, 1)), True).otherwise(~(swapped | strange))


def units_in(sentence: Column) -> Column:
    return F.aggregate(F.transform(reveal.words(sentence), lambda w: F.size(reveal.notes_apart(w))), F.lit(0), lambda s, n: s + n)


def missed(rows: DataFrame, *, sentences: str, depth: str, read: str) -> DataFrame:
    """``rows`` with ``last_heard``, the place of the last sentence heard before a buzz, and ``asked``, the places of up to three before it.

    ``depth`` is the share of the text at the buzz, words that were skipped included; null: all
    was heard.  ``read`` is how many of the last sentences were read; 0 or null: all.  A buzz in
    the first sentence asks for that one.
    """
    s, n = F.col(sentences), F.size(sentences)
    kept = F.coalesce(F.col(read), F.lit(0))
    rows = rows.withColumn("_start", F.when((kept > 0) & (n > kept), n - kept).otherwise(0))
    rows = rows.withColumn("_units", F.transform(s, lambda x, i: F.when(i < F.col("_start"), F.size(reveal.words(x))).otherwise(units_in(x))))
    add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    rows = rows.withColumn("_skipped", add(F.slice("_units", F.lit(1), F.col("_start")))).withColumn("_all", add(F.col("_units")))
    at = F.floor(F.col(depth) * F.col("_all") + 0.5) - F.col("_skipped")
    rows = rows.withColumn("_at", F.greatest(F.lit(0), F.least(F.col("_all") - F.col("_skipped"), at)))
    own = F.slice("_units", F.col("_start") + 1, F.greatest(n - F.col("_start"), F.lit(0)))
    ends = F.transform(own, lambda x, i: add(F.slice(own, F.lit(1), i + 1)))
    past = F.size(F.filter(ends, lambda e: e < F.col("_at")))
    last = F.when(F.col(depth).isNull(), n - 1).otherwise(F.least(n - 1, F.col("_start") + past))
    rows = rows.withColumn("last_heard", F.when(n > 0, last.cast("int")))
    back = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ASKED_BACK)), lambda k: F.col("last_heard") - k), lambda q: q >= 0)
    asked = F.when(F.size(back) > 0, back).otherwise(F.array("last_heard"))
    return rows.withColumn("asked", F.when(F.col("last_heard").isNotNull(), asked)).drop("_start", "_units", "_skipped", "_all", "_at")


def voted(votes: DataFrame, *, key: str, choice: str, weight: str, least: float = LEAST_WEIGHT, margin: float = LEAST_MARGIN) -> DataFrame:
    """(key, choice, score): what a key's votes agree on: at least ``least`` in all, and ``margin`` times as much as the next."""
    sums = votes.groupBy(key, choice).agg(F.sum(weight).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), choice)
    ranked = sums.withColumn("_p", F.row_number().over(order)).withColumn("_next", F.lead("score", 1, 0.0).over(order))
    return ranked.where((F.col("_p") == 1) & (F.col("score") >= least) & (F.col("score") >= margin * F.col("_next"))).select(key, choice, "score")
