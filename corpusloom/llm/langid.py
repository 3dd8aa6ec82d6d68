"""Language identification by averaged hashed subword embeddings.

Every letter of a text gives two subwords, itself with its neighbours on both
sides (3 and 5 code points, anything but a letter as a blank), hashed to a table
of embeddings.  Their mean goes through a linear softmax.  Table and softmax are
trained by stochastic gradient descent in numpy on a bounded, stratified sample
(``PER_LANGUAGE`` texts a language, fewer where ``MOST_COUNTS`` subword counts in
all would be passed, so that the driver's memory doesn't grow with languages or
texts); a held-back fifth of the sample gives the
temperature of the scores and the score below which a text is rejected.  As the
model is linear after the mean, scoring needs one table of class scores a bucket.

Defined cases: null text and text without a letter are ``und`` with score 0; with
nothing to learn from every text is; a text of any length counts whole; ties go
to the language that sorts first; repeated rows get equal results; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_batches, shuffle_partitions, slices
from .textarrays import bucket_of, code_points, letters, mixed, stratified

BUCKETS = 1 << 15
DIMS = 16
PER_LANGUAGE = 1_500
#: Subword counts of all sampled texts that the driver takes, about; of many languages each has fewer texts.
MOST_COUNTS = 16_000_000
EPOCHS = 6
RATE = 2.0
UNKNOWN = "und"
#: Share of rightly labelled calibration texts that rejection may lose.
LOSS = 0.001


def subwords(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords and, for each, the text it is of."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    is_letter = letters(cps)
    padded = np.zeros(len(cps) + 4 * len(offsets), np.uint64)
    place = np.arange(len(cps)) + 4 * of + 2
    padded[place] = np.where(is_letter, cps, 0)
    at, of = place[is_letter], of[is_letter]
    three = padded[at - 1] << np.uint64(42) | padded[at] << np.uint64(21) | padded[at + 1]
    five = mixed(three) + padded[at - 2] * np.uint64(0xD6E8FEB86659FD93) + padded[at + 2] * np.uint64(0xA0761D6478BD642F)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([mixed(three) * np.uint64(0x9E3779B97F4A7C15) >> shift, mixed(five) * np.uint64(0x9E3779B97F4A7C15) >> shift]).astype(np.int64), np.concatenate([of, of])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray = field(repr=False)  # class scores of each bucket
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities and the number of subwords of each text."""
        bucket, of = subwords(*code_points(texts))
        n = np.bincount(of, minlength=len(texts))
        z = np.stack([np.bincount(of, self.table[bucket, k], len(texts)) for k in range(len(self.languages))], 1)
        return softmax((z / np.maximum(n, 1)[:, None] + self.bias) / self.temperature), n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model | None:
    """Train on (distinct buckets, shares of the text's subwords, language) and calibrate on every fifth row."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    y = np.array([languages.index(r[2]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[::5] if len(rows) >= 50 else order
    train = np.setdiff1d(order, held) if len(rows) >= 50 else order
    emb = rng.normal(0, 1 / DIMS, (BUCKETS, DIMS))
    w, b = rng.normal(0, 1 / DIMS, (DIMS, len(languages))), np.zeros(len(languages))
    steps = EPOCHS * max(1, -(-len(train) // 16))
    if len(train) < 2_000:
        steps = max(steps, 750)
    left = np.array([], np.int64)
    for step in range(steps):
        if len(left) < 16:
            left = np.concatenate([left, rng.permutation(train)])
        pick, left = left[:16], left[16:]
        rate = RATE * (1 - step / steps)
        idx, val = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
        of = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
        h = np.stack([np.bincount(of, emb[idx, d] * val, len(pick)) for d in range(DIMS)], 1)
        g = softmax(h @ w + b)
        g[np.arange(len(pick)), y[pick]] -= 1
        back = g @ w.T
        w -= rate * (h.T @ g) / len(pick)
        b -= rate * g.mean(0)
        np.add.at(emb, idx, -rate * val[:, None] * back[of])
    model = Model(languages, emb @ w, b)
    z = np.stack([(model.table[i] * v[:, None]).sum(0) + b for i, v, _ in (rows[k] for k in held)])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    model.temperature = min((float(t) for t in np.geomspace(0.1, 5, 40)), key=loss)
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    model.reject_below = min(0.5, float(np.quantile(right, LOSS)) * 0.9) if len(right) else 0.0
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 5, per_language: int = PER_LANGUAGE, most_counts: int = MOST_COUNTS) -> Model | None:
    """Fit on texts with a language whose crc32(id) is not held out; their subword counts alone reach the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), held_out_mod) != 0))

    def make():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                bucket, of = subwords(*code_points(part.column("text")))
                key, n = np.unique(of * BUCKETS + bucket, return_counts=True)
                total = np.bincount(of, minlength=part.num_rows)
                ends = np.searchsorted(key // BUCKETS, np.arange(part.num_rows + 1)).astype(np.int32)
                share = n / np.maximum(total, 1)[key // BUCKETS]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array((key % BUCKETS).astype(np.int16))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(share.astype(np.float32))),
                        part.column("lang"),
                    ],
                    names=["doc_id", "bucket", "share", "lang"],
                )

        return step

    # a text has at most so many distinct subwords; the mean over a language's texts bounds their sum
    width = F.avg(F.least(F.lit(BUCKETS), 2 * F.char_length("text") + 1))
    widths = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(width.alias("n")).collect()}
    quota = {k: min(per_language, max(20, int(most_counts / len(widths) / (n or 1)))) for k, n in widths.items()}
    # rows that are alike in all three fall on the same side, so they count once
    picked = stratified(rows, "lang", ("doc_id", "text"), quota).dropDuplicates(["doc_id", "text", "lang"])
    picked = picked.repartition(shuffle_partitions(docs.sparkSession))  # small as it is, the sample is work for all tasks
    got = map_batches(picked, make, "doc_id long, bucket array<short>, share array<float>, lang string").toArrow().combine_chunks().sort_by("doc_id")
    bucket, share = (got.column(c).combine_chunks() for c in ("bucket", "share"))
    ends = np.asarray(bucket.offsets)
    bucket, share = np.asarray(bucket.values), np.asarray(share.values)
    table = [(bucket[a:b], share[a:b], lang) for a, b, lang in zip(ends[:-1].tolist(), ends[1:].tolist(), got.column("lang").to_pylist()) if b > a]
    return fit(table)


def judged(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text."""
    n = len(texts)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    p, seen = model.scores(texts)
    best = p.argmax(1)
    score = np.where(seen > 0, p[np.arange(n), best], 0.0)
    label = [model.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), seen.tolist())]
    return label, score, (seen > 0) & (score >= model.reject_below)


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): ``accepted`` is false for ``und`` and below the calibrated score."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(bucket_of(F.col(id_col), held_out_mod) == 0, F.lit(False)).alias("held_out"),
    )

    def make():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                label, score, ok = judged(model, part.column("text"))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(label, pa.string()), pa.array(score), pa.array(ok)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

        return step

    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all of them."""
    return predict(docs, train(docs, **options))


def identified_only(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns; all rows if there is none to learn."""
    model = train(docs, text_col=text_col, **options)
    return docs if model is None else keep_rows(docs, text_col, lambda: lambda texts: judged(model, texts)[2])
