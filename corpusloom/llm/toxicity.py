"""Toxicity by a counterfactually regularised classifier.

A text's features are the words it holds and their beginnings of 4 to 7 letters,
each once, by 64-bit hashes.  Candidates come from a bounded, stratified sample
of labelled texts (``PER_CLASS`` a class): counts by class are aggregated on the
cluster and the ``MAX_FEATURES`` with the strongest association are kept.  A
logistic regression on them is fitted in numpy.  For every labelled sentence
that names a group, copies with the group's name swapped for others are made
too, and the squared change of the score is part of the loss, so the name of a
group can't carry weight by itself and neutral mentions aren't marked.  The
sample's class shares are undone in the intercept.

Defined cases: null and empty texts get the intercept's score; a text of any
length counts whole; without labels of both classes every score is the share of
toxic labels (0 without any); conflicting labels of one id, and of equal texts, all
count: a text is learnt once, with the mean of its labels; repeated rows get equal
scores and ties of features go to the smaller hash; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, map_batches, shuffle_partitions, slices
from .textarrays import bucket_of, code_points, letters, mixed, stratified

#: Names of groups, in sets whose members are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young"),
)
PREFIXES = (4, 5, 6, 7)
PER_CLASS = 3_000
MAX_FEATURES = 4_096
LEAST_TEXTS = 3
LEAST_CHI2 = 15.0
ROUNDS = 600
RATE = 0.05
RIDGE = 1e-5
#: A feature needs about this many toxic texts of the sample, and this share of them, to get a weight.
LEAST_SUPPORT = 2.0
SUPPORT_SHARE = 0.01
COUNTERFACTUAL = 4.0
THRESHOLD = 0.7
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Turns the key of a feature into that of its being there twice.
TWICE = np.uint64(0xA5A5A5A55A5A5A5A)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def features(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings, and the text of each; repeats included."""
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    is_letter = letters(cps)
    edge = np.zeros(len(cps) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(is_letter & (edge[:-1] | ~np.concatenate(([False], is_letter[:-1]))))
    stop = np.flatnonzero(is_letter & (edge[1:] | ~np.concatenate((is_letter[1:], [False])))) + 1
    power = np.cumprod(np.full(len(cps), BASE))
    inverse = np.cumprod(np.full(len(cps), BASE_INVERSE))
    total = np.concatenate(([np.uint64(0)], np.cumsum(cps.astype(np.uint64) * power)))
    of = np.searchsorted(offsets, start, side="right") - 1
    size = stop - start

    def digest(at, to, kind):
        return mixed((total[to] - total[at]) * inverse[at] + np.uint64(kind))

    keys, texts = [digest(start, stop, 1)], [of]
    for n in PREFIXES:
        long_ = size > n
        keys.append(digest(start[long_], start[long_] + n, 2 + n))
        texts.append(of[long_])
    return np.concatenate(keys), np.concatenate(texts)


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of each text once, and another one if it is there twice or more; sorted by text."""
    key, of = features(*code_points(texts))
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    again = first[np.diff(np.append(first, len(key))) > 1]
    key, of = np.concatenate([key[first], key[again] ^ TWICE]), np.concatenate([of[first], of[again]])
    order = np.argsort(of, kind="stable")
    return key[order], of[order]


@lru_cache(256)
def term_pattern(group: tuple[str, ...]) -> re.Pattern:
    """Any name of a set, as a whole word in any case."""
    return re.compile(r"(?<![^\W\d_])(" + "|".join(sorted(map(re.escape, group), key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE)


def counterfactuals(text: str, groups=IDENTITY_TERMS) -> list[str]:
    """The text with each group's names swapped, one copy for each step around its set."""
    out = []
    for group in groups:
        pattern = term_pattern(group)
        if pattern.search(text):
            places = {t: i for i, t in enumerate(group)}
            out += [pattern.sub(lambda m, k=k: group[(places[m[0].lower()] + k) % len(group)], text) for k in range(1, len(group))]
    return out


@dataclass
class Model:
    keys: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    intercept: float = 0.0
    #: Keys of single features, with the weights of being there, and of being there twice.
    bases: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64), repr=False)
    once: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    twice: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        if len(self.bases):
            key, of = features(*code_points(texts))
            at = np.minimum(np.searchsorted(self.bases, key), len(self.bases) - 1)
            hit = self.bases[at] == key
            pairs, times = np.unique(of[hit] * len(self.bases) + at[hit], return_counts=True)
            of, at = pairs // len(self.bases), pairs % len(self.bases)
            z += np.bincount(of, self.once[at] + np.where(times > 1, self.twice[at], 0.0), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def model_of(keys: np.ndarray, weights: np.ndarray, intercept: float) -> Model:
    bases = np.unique(np.concatenate([keys, keys ^ TWICE]))

    def weight(k):
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, weights[at], 0.0)

    once, twice = weight(bases), weight(bases ^ TWICE)
    used = (once != 0) | (twice != 0)
    return Model(keys, weights, intercept, bases[used], once[used], twice[used])


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, n_features: int, swaps: list[tuple[np.ndarray, np.ndarray]], strength: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept; (row, col) are the features that texts have, ``y`` the share of toxic labels of each, ``swaps`` the features of a sentence and its copy.

    A first fit with an absolute penalty leaves the few features that explain
    many labels, so words that some toxic texts share by chance fall out; a second
    fit of these alone has next to no penalty.  Both have the counterfactual one.
    """
    n, n_pos, all_row = len(y), float(y.sum()), row
    s_row = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(swaps)]) if swaps else np.zeros(0, np.int64)
    s_col = np.concatenate([np.concatenate(p) for p in swaps]) if swaps else np.zeros(0, np.int64)
    s_val = np.concatenate([np.concatenate((np.ones(len(a)), -np.ones(len(b)))) for a, b in swaps]) if swaps else np.zeros(0)

    def descend(open_: np.ndarray, shrink: float, ridge: float, rounds: int, balance: float) -> np.ndarray:
        used = open_[col]
        row, col_ = all_row[used], col[used]
        w = np.zeros(n_features + 1)
        w[-1] = np.log((n_pos + 0.5) / (n - n_pos + 0.5))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            z = np.bincount(row, w[col_], n) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            r = (p * (1 - y) - balance * (1 - p) * y) / n
            g = np.append(np.bincount(col_, r[row], n_features), r.sum())
            g[:-1] += ridge * w[:-1]
            if len(swaps):
                change = np.bincount(s_row, w[s_col] * s_val, len(swaps))
                g[:-1] += 2 * strength / len(swaps) * np.bincount(s_col, change[s_row] * s_val, n_features)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            scale = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w = w - scale * (m / (1 - 0.9**step))
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - scale[:-1] * shrink, 0) * open_
        return w

    support = LEAST_SUPPORT + SUPPORT_SHARE * n_pos
    first = descend(np.ones(n_features, bool), 0.5 * support / n, 0.0, ROUNDS, 1.0)
    kept = np.abs(first[:-1]) > 1e-6
    w = descend(kept, 0.0, RIDGE, 4 * ROUNDS, max(1.0, (n - n_pos) / max(1.0, n_pos)))
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out_mod: int = 3,
    held_out_value: int = 1,
    per_class: int = PER_CLASS,
    groups=IDENTITY_TERMS,
    strength: float = COUNTERFACTUAL,
) -> Model:
    """Fit on labelled rows that aren't held out."""
    y = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(
        F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & (bucket_of(F.col("__id"), held_out_mod) != held_out_value)
    )
    shares = {r[0]: r[1] for r in y.groupBy("__y").count().collect()}
    pos, neg = shares.get(1, 0), shares.get(0, 0)
    ids = y.groupBy("__id").agg(F.avg("__y").alias("__share")).withColumn("__class", F.when(F.col("__share") >= 0.5, 1).otherwise(0))
    flat = float(np.log((pos + 1e-6) / (neg + 1e-6)))
    none = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.clip(flat, -30, 30)))
    if not pos or not neg:
        return none
    quota = {0: per_class, 1: per_class}
    picked = stratified(ids, "__class", ("__id",), quota)  # a row an id, so about twice per_class
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "__id")
    # an id may have many rows; equal texts are one, whose label is the mean of theirs
    order = F.xxhash64(F.lit(21), "text", "__id")
    chosen = [rows.where(F.col("__class") == c).orderBy(order, "__id", "text").limit(2 * per_class) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).groupBy("text").agg(F.avg("__share").alias("__y"))
    # small as it is, the sample is work for all tasks
    sample = cut(sample.repartition(shuffle_partitions(docs.sparkSession)))

    def sample_features():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                key, of = distinct_features(part.column("text"))
                yield pa.record_batch([pa.array(key.view(np.int64)), part.column("__y").take(pa.array(of))], names=["key", "y"])

        return step

    seen = map_batches(sample, sample_features, "key long, y double")
    a, b = F.col("p"), F.col("n")
    total = sample.agg(F.sum("__y"), F.sum(1 - F.col("__y"))).first()
    tp, tn = float(total[0] or 0), float(total[1] or 0)
    if not tp or not tn:
        return none
    expect_p, expect_n = (a + b) * tp / (tp + tn), (a + b) * tn / (tp + tn)
    rest = lambda seen_, all_: F.greatest(F.lit(1.0), F.lit(all_) - seen_)
    chi2 = F.pow(a - expect_p, 2) * (1 / expect_p + 1 / rest(expect_p, tp)) + F.pow(b - expect_n, 2) * (1 / expect_n + 1 / rest(expect_n, tn))
    strong = (
        seen.groupBy("key")
        .agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))
        .where(a + b >= LEAST_TEXTS)
        .withColumn("chi2", chi2)
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "key")
        .limit(MAX_FEATURES)
    )
    identity = np.unique(np.concatenate([distinct_features(pa.array([t]))[0] for g in groups for t in g])) if groups else np.zeros(0, np.uint64)
    keys = np.unique(np.concatenate([np.array([r[0] for r in strong.select("key").collect()], np.int64).view(np.uint64), identity]))

    def found(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        key, of = distinct_features(texts)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return at[hit], of[hit]

    def training_rows():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                col, of = found(part.column("text"))
                ends = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
                swaps = []
                for text in part.column("text").to_pylist():
                    pairs = []
                    named = [g for g in groups if term_pattern(g).search(text or "")]
                    for sentence in re.split(r"(?<=[.!?])\s+|\n", text or "") if named else []:
                        for copy in counterfactuals(sentence, named):
                            c, o = found(pa.array([sentence, copy]))
                            pairs.append([c[o == 0].tolist(), c[o == 1].tolist()])
                    swaps.append(pairs)
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(pa.array(ends), pa.array(col)), part.column("__y"), pa.array(swaps, pa.list_(pa.list_(pa.list_(pa.int64()))))],
                    names=["col", "y", "swaps"],
                )

        return step

    rows = map_batches(sample, training_rows, "col array<long>, y double, swaps array<array<array<long>>>").toArrow().to_pylist()
    if not rows or not len(keys):
        return none
    rows.sort(key=lambda r: (r["y"], r["col"]))
    labels_ = np.array([r["y"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["col"]) for r in rows])
    col = np.array([c for r in rows for c in r["col"]], np.int64)
    swaps = [(np.array(a, np.int64), np.array(b, np.int64)) for r in rows for a, b in r["swaps"] or []]
    weights, intercept = fit(row, col, labels_, len(keys), swaps, strength)
    return model_of(keys, weights, intercept)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 3, held_out_value: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(bucket_of(F.col(id_col), held_out_mod) == held_out_value, F.lit(False)).alias("held_out"),
    )

    def make():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                s = model.scores(part.column("text"))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return step

    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labels and score every row of ``docs``."""
    return score(docs, train(docs, labels, **options))


def without_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = train(docs, labels, text_col=text_col, **options)
    return keep_rows(docs, text_col, lambda: lambda texts: model.scores(texts) < threshold)
