"""Tiered matching, precedence overrides, linking and graphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import sized

#: Rows whose groups are paired in one task, about.
PAIRED_ROWS = 250_000


def unique_alias(aliases: DataFrame, exact: DataFrame) -> DataFrame:
    """(key, slug) of aliases that name one slug only and aren't exact keys themselves."""
    one = aliases.groupBy("key").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("slug")).where("n = 1").drop("n")
    return one.join(exact.select("key"), "key", "left_anti")


def tiered(rows: DataFrame, overrides: DataFrame, exact: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add (slug, status): override (whose slug may be null), exact, alias, else unmatched.

    ``rows`` has key and category; ``overrides`` (key, slug), ``exact`` and
    ``aliases`` (key, slug, category).  An alias of another known category is no match.
    """
    o = overrides.select("key", F.col("slug").alias("o_slug"), F.lit(True).alias("decided"))
    e = exact.select("key", F.col("slug").alias("e_slug"))
    a = aliases.select("key", F.col("slug").alias("a_slug"), F.col("category").alias("a_cat"))
    fits = F.col("a_slug").isNotNull() & (F.col("category").isNull() | F.col("a_cat").isNull() | (F.col("category") == F.col("a_cat")))
    status = F.when(F.col("decided"), "override").when(F.col("e_slug").isNotNull(), "exact").when(fits, "alias").otherwise("unmatched")
    return (
        rows.join(o, "key", "left")
        .join(e, "key", "left")
        .join(a, "key", "left")
        .withColumn("status", status)
        .withColumn("slug", F.expr("CASE status WHEN 'override' THEN o_slug WHEN 'exact' THEN e_slug WHEN 'alias' THEN a_slug END"))
        .drop("o_slug", "e_slug", "a_slug", "a_cat", "decided")
    )


def first_by_precedence(rows: DataFrame, layers: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Add (target, decided) from the first layer with an entry; an entry may hold null.

    Each layer is (frame with its keys and ``target``, keys).
    """
    out, hits = rows, []
    for k, (layer, keys) in enumerate(layers):
        out = out.join(layer.select(*keys, F.col("target").alias(f"_t{k}"), F.lit(True).alias(f"_d{k}")), keys, "left")
        hits.append(k)
    target, decided = F.lit(None).cast("string"), F.lit(False)
    for k in reversed(hits):
        target = F.when(F.col(f"_d{k}"), F.col(f"_t{k}")).otherwise(target)
        decided = F.coalesce(F.col(f"_d{k}"), F.lit(False)) | decided
    return out.withColumn("target", target).withColumn("decided", decided).drop(*(f"_{x}{k}" for k in hits for x in "td"))


def co_occurrence(rows: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, n): in how many groups two items meet, a < b.

    A task sorts, joins and counts the groups of about ``PAIRED_ROWS`` rows before pairs are shuffled.
    """
    pairs = sized(rows.select(group, item), PAIRED_ROWS, group).distinct()
    left, right = pairs.withColumnRenamed(item, "a"), pairs.withColumnRenamed(item, "b")
    return left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, fwd, rev, score) of directed weights (a, b, n), one row for each direction that exists."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("rev"))
    joined = edges.withColumnRenamed("n", "fwd").join(back, ["a", "b"], "full_outer")
    return joined.select("a", "b", F.coalesce("fwd", F.lit(0)).alias("fwd"), F.coalesce("rev", F.lit(0)).alias("rev")).withColumn("score", F.col("fwd") + F.col("rev"))


def top_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def claimable(items: DataFrame, waiting: Column, claimed: Column, since: Column, now: Column, lease: str = "1800 seconds") -> DataFrame:
    """Items to hand out at ``now``: those that wait, and claimed ones whose lease has run out.

    A runner that asks every so often passes the current time; nothing need fire when a lease ends.
    """
    return items.where(waiting | (claimed & (since < now - F.expr(f"interval {lease}"))))


# Capitalised words that don't make a name longer.
NOT_NAMES = frozenset("The A An In On Of For And But Or To By At From With As This That These Those His Her Its He She It They When While After Before".split())


NAME_WORD = r"([\p{L}\p{N}_]+)"
SNIPPET = 60


def longer_name(text: str, start: int, end: int) -> bool:
    """Whether a word touches a capitalised word that isn't one of the small words, and so is part of a longer name."""
    before, after = re.search(r"([A-Z][\w'-]*) $", text[max(0, start - 40) : start]), re.match(r" ([A-Z][\w'-]*)", text[end : end + 40])
    return any(m and m[1] not in NOT_NAMES for m in (before, after))


def whole_words(text: str, surface: str) -> list[int]:
    """Where ``surface`` stands between word boundaries, leftmost first and without overlaps, as a pattern ``\\b...\\b`` finds it."""
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    n, found, at = len(surface), [], text.find(surface)
    while at >= 0:
        whole = word(at - 1) != word(at) and word(at + n - 1) != word(at + n)
        if whole:
            found.append(at)
        at = text.find(surface, at + (max(n, 1) if whole else 1))
    return found


def linked(text: str, surfaces: dict[str, list[tuple[str, str]]], own: str | None, own_name: str | None, guard: bool = True) -> list[tuple[str, str, int, str, str | None]]:
    """(target, surface, position, tier, snippet) of one text.

    ``surfaces`` gives (target, tier) pairs.  Longer surfaces are looked for first, as whole words
    and in their own case, and all their places are masked, also where the first place is part of a
    longer name and so no link.  A surface inside the text's own name, or of its own target, is no
    link.  A target counts once a text.  Of a surface that no "auto" target has, every target is a
    candidate to be judged, with the text around it.
    """
    masked, seen, out = text, set(), []
    for surface in sorted(surfaces, key=lambda x: (-len(x), x)):
        hits = whole_words(masked, surface)
        if not hits:
            continue
        start, end = hits[0], hits[0] + len(surface)
        part = guard and len(surface.split()) == 1 and longer_name(masked, start, end)
        ends = [0, *(h + len(surface) for h in hits)]
        masked = (" " * len(surface)).join([masked[a:b] for a, b in zip(ends, [*hits, len(masked)])])
        if part or (own_name and surface in own_name):
            continue
        sure = [t for t, tier in surfaces[surface] if tier == "auto"][:1]
        for target in sure or sorted(t for t, _ in surfaces[surface]):
            if target == own or (sure and target in seen):
                continue
            if sure:
                seen.add(target)
            around = None if sure else text[max(0, start - SNIPPET) : end + SNIPPET].replace("\n", " ").strip()
            out.append((target, surface, start, "auto" if sure else "gated", around))
    return out


def link_mentions(texts: DataFrame, lexicon: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", own_col: str | None = None, own_name_col: str | None = None, guard: bool = True) -> DataFrame:
    """(id, target, surface, position, tier, snippet): surfaces of a lexicon found in texts, by the rules of ``linked``.

    ``lexicon`` holds surface, target and, if some are to be judged, tier ("auto" or "gated").
    Each surface is looked up by the one of its words that fewest texts hold, so a text meets
    only surfaces whose rarest word it has.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(NAME_WORD), F.lit(1)))
    tier = F.col("tier") if "tier" in lexicon.columns else F.lit("auto")
    lex = lexicon.select("surface", "target", tier.alias("tier")).where("surface is not null and target is not null").distinct()
    of_surface = lex.select("surface").distinct().select("surface", F.explode(words(F.col("surface"))).alias("word"))
    in_text = texts.select(F.col(id_col), F.explode(words(F.col(text_col))).alias("word")).join(of_surface.select("word").distinct(), "word", "left_semi")
    often = in_text.groupBy("word").agg(F.count("*").alias("often"))
    rarest = of_surface.join(often, "word", "left").groupBy("surface").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))
    entry = F.struct("surface", "target", "tier")
    cand = in_text.join(lex.join(rarest, "surface"), "word").groupBy(id_col).agg(F.collect_set(entry).alias("found"))
    own = [F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((own_col, "_own"), (own_name_col, "_own_name"))]
    both = texts.select(id_col, text_col, *own).join(cand, id_col)

    def scan(frames):
        for frame in frames:
            out = []
            for i, text, mine, my_name, found in frame.itertuples(index=False, name=None):
                surfaces: dict[str, list[tuple[str, str]]] = {}
                for row in found:
                    surfaces.setdefault(row["surface"], []).append((row["target"], row["tier"]))
                out += [(i, *x) for x in linked(text, {k: sorted(v) for k, v in surfaces.items()}, mine, my_name, guard)]
            yield pd.DataFrame(out, columns=[id_col, "target", "surface", "position", "tier", "snippet"])

    kind = texts.schema[id_col].dataType.simpleString()
    return both.mapInPandas(scan, f"{id_col} {kind}, target string, surface string, position long, tier string, snippet string")


def fuzzy_pairs(left: DataFrame, right: DataFrame, most: int, key: str = "key") -> DataFrame:
    """(key, near, distance): keys of ``right`` within ``most`` edits.

    Blocked by length and by one of ``most + 1`` even pieces, one of which two
    such keys must share nearly in place.
    """
    n = most + 1

    def pieces(c: str, shift: bool) -> Column:
        size = F.length(c)
        out = []
        for k in range(n):
            at, to = F.floor(size * k / n), F.floor(size * (k + 1) / n)
            for d in range(-most, most + 1) if shift else [0]:
                out.append((k, d, at, to))
        return out

    r = right.select(F.col(key).alias("near")).distinct()
    r = r.select("near", F.length("near").alias("size"), F.explode(F.array(*(
        F.struct(F.lit(k).alias("k"), F.substring("near", (at + 1).cast("int"), (to - at).cast("int")).alias("piece")) for k, _, at, to in pieces("near", False)
    ))).alias("p"))
    rows = []
    for delta in range(-most, most + 1):
        size = F.length(key) + delta
        for k in range(n):
            at, to = F.floor(size * k / n), F.floor(size * (k + 1) / n)
            for d in range(-most, most + 1):
                rows.append(F.struct(size.alias("size"), F.lit(k).alias("k"), F.substring(key, (at + 1 + d).cast("int"), (to - at).cast("int")).alias("piece")))
    l = left.select(key).distinct().select(key, F.explode(F.array_distinct(F.array(*rows))).alias("q"))
    hit = l.join(r, (F.col("q.size") == F.col("size")) & (F.col("q.k") == F.col("p.k")) & (F.col("q.piece") == F.col("p.piece")))
    dist = F.levenshtein(F.col(key), F.col("near"))
    return hit.select(key, "near").distinct().where(F.col(key) != F.col("near")).withColumn("distance", dist).where(F.col("distance") <= most)


def ratio_pairs(left: DataFrame, right: DataFrame, *, key: str = "key", least: float = 0.82) -> DataFrame:
    """(key, near, ratio): all keys of ``right`` whose matching-block ratio to ``key`` is at least ``least``.

    With lengths a and b, at least m = least * (a + b) / 2 letters lie in at most a + b - 2 m + 1
    matching blocks, so the keys share m minus that many pairs of neighbouring letters.  Pairs
    of letters have one order, rare ones first, and of two such keys the first shared pair lies
    among the first of each that are left when all but the shared ones are gone: only keys that
    share one of those are rated.  Keys of one letter match themselves alone.
    """
    from difflib import SequenceMatcher

    from pyspark.sql.types import DoubleType

    def grams(rows: DataFrame, name: str) -> DataFrame:
        size = F.length(name)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - 1)), lambda i: F.substring(name, i, F.lit(2)))
        # the n-th time that a pair occurs is a pair of its own
        told = F.transform(pairs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i + 1), lambda x: x == g)).cast("string")))
        return rows.select(F.col(key).alias(name)).distinct().where(F.length(name) > 0).select(name, size.alias("size"), F.explode(told).alias("gram"))

    a, b = grams(left, "_a"), grams(right, "_b")
    often = a.select("gram").unionByName(b.select("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    shortest = least / (2 - least)  # of the other key, against this one's length

    def firsts(rows: DataFrame, name: str) -> DataFrame:
        total = F.ceil(F.col("size") * shortest) + F.col("size")
        m = F.ceil(total * (least / 2) - 1e-9)
        shared = F.greatest(F.lit(1), m - (total - 2 * m + 1))
        place = F.row_number().over(Window.partitionBy(name).orderBy("often", "gram"))
        ranked = rows.join(often, "gram").withColumn("_p", place)
        return ranked.where(F.col("_p") <= F.greatest(F.lit(1), F.col("size") - 1) - shared + 1).select(name, F.col("size").alias(f"{name}_size"), "gram")

    hit = firsts(a, "_a").join(firsts(b, "_b"), "gram")
    near = hit.where((F.col("_a") != F.col("_b")) & (2 * F.least("_a_size", "_b_size") >= least * (F.col("_a_size") + F.col("_b_size")) - 1e-9)).select("_a", "_b").distinct()
    ratio = F.pandas_udf(lambda x, y: x.combine(y, lambda p, q: SequenceMatcher(None, p, q).ratio()), DoubleType())
    return near.withColumn("ratio", ratio("_a", "_b")).where(F.col("ratio") >= least).select(F.col("_a").alias("key"), F.col("_b").alias("near"), "ratio")
