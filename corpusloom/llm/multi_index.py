"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by a codebook of their own, so ``words`` words
a half give ``words * words`` cells; what is left of a vector is kept as a byte for
each of ``PARTS`` parts of it.  A query walks centroid pairs in the order of their
summed squared distances, from a heap, until the cells hold a share of all entries.
Entries of these cells, and no others, are ranked by their codes with tables of one number
for each code.  Of each bucket the ``shortlist`` best, at least a quarter of those ranked, are
reranked by the exact distance in the same task: where vectors lie much closer together than
their codes can tell, few best codes don't hold the nearest.  Only a bucket's nearest leave
the task.

The codebooks are fitted on a bounded sample (``SAMPLE`` rows, chosen by a hash); the
share to walk is the one at which sampled queries meet ``target`` of their nearest
in the sample.  Clustered vectors need a small one, evenly spread vectors a large one.
Every row is indexed.  Cells are dealt to buckets in the order of their centroids, and
a cell larger than a bucket's share is split over several, so a vector that fills a
third of the table spreads.  A query goes once to each bucket it needs.

Defined cases: vectors that are null, empty, all zero, of another length than
the most usual one, or that hold null or non-finite components take no part, nor do
rows without an id; ties go to the smaller id; rows that repeat an id are queries and
candidates of their own, and a query finds every row but itself, so repeated query
rows have ten neighbours each; components of any finite size are compared, as codes
are made at the table's own scale and distances that overflow are scaled; a query with
fewer candidates gets all of them; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shuffle_partitions, written

#: Words a half for tables of up to so many rows, and beyond.
WORDS = ((2_000_000, 128), (30_000_000, 256))
MOST_WORDS = 512
PARTS = 16
SAMPLE = 20_000
ROUNDS = 8
TRIES = 256
#: Share of the sample's nearest neighbours that the walk must meet.
TARGET = 0.96
#: Entries of a bucket, about.
BUCKET_ROWS = 200_000
#: One in so many of a bucket's ranked entries is reranked at least.
RERANKED = 4
#: Components are clipped here, in units of the table's scale, before they are quantised.
REACH = 1e12


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls and of one length as a matrix."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], 1) if x.shape[1] else np.zeros_like(centres)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows; each is summed in one order, whatever stands beside it, unlike by a matrix product."""
    return np.einsum("id,jd->ij", np.ascontiguousarray(x), np.ascontiguousarray(y))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * products(x, centres) + (centres * centres).sum(1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(x, centres).argmin(1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, scaled where squares leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        diff = x - y
        total = (diff * diff).sum(1)
        odd = np.flatnonzero(~((total > 1e-280) & (total < 1e280)))
        out = np.sqrt(total)
        if len(odd):
            half = x[odd] / 2 - (y if y.ndim == 1 else y[odd]) / 2
            most = np.abs(half).max(1)
            unit = half / np.where(most > 0, most, 1.0)[:, None]
            out[odd] = 2 * most * np.sqrt((unit * unit).sum(1))
    return out


class Codebooks:
    """Two coarse codebooks, a codebook for each part of the residual, and the share to walk."""

    def __init__(self, fit: np.ndarray, words: int, seed: int, k_nearest: int, target: float):
        self.dims = fit.shape[1]
        size = np.abs(fit).max(1)
        self.scale = float(np.median(size[size > 0])) if (size > 0).any() else 1.0
        x = self.scaled(fit)
        self.half = self.dims // 2 if self.dims > 1 else 1
        self.c1 = k_means(x[:, : self.half], words, ROUNDS, seed)
        self.c2 = k_means(x[:, self.half :], words, ROUNDS, seed + 1) if self.dims > 1 else np.zeros((1, 0))
        self.cuts = np.linspace(0, self.dims, min(PARTS, self.dims) + 1).astype(int).tolist()
        rest = x - self.coarse(self.cells(x))
        self.books = [k_means(rest[:, a:b], 256, ROUNDS, seed + 2 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        self.share = self.calibrated(x, k_nearest, target)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x / self.scale, -REACH, REACH)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.c1) * len(self.c2) + nearest(x[:, self.half :], self.c2)

    def coarse(self, cell: np.ndarray) -> np.ndarray:
        return np.concatenate([self.c1[cell // len(self.c2)], self.c2[cell % len(self.c2)]], 1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.coarse(cell)
        return np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], 1).astype(np.uint8)

    def rests(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What an entry's codes add to a distance, whatever the query: 2 coarse * rest + rest * rest."""
        rest = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)
        return (rest * (2 * self.coarse(cell) + rest)).sum(1)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each part 2 query * rest by query and code."""
        return [2 * products(x[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)]

    def to_words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their words."""
        return squared(x[:, : self.half], self.c1), squared(x[:, self.half :], self.c2)

    def calibrated(self, x: np.ndarray, k_nearest: int, target: float) -> float:
        """The share of entries, in walking order, that holds ``target`` of the nearest of sampled queries."""
        k = min(k_nearest, len(x) - 1)
        if k < 1:
            return 1.0
        cell = self.cells(x)
        asks = np.arange(min(TRIES, len(x)))
        place = []
        for at in range(0, len(asks), 32):
            q = asks[at : at + 32]
            own = np.arange(len(q))
            far = (x[q] * x[q]).sum(1)[:, None] - 2 * x[q] @ x.T + (x * x).sum(1)
            far[own, q] = np.inf
            top = np.argpartition(far, k - 1, axis=1)[:, :k]
            d1, d2 = self.to_words(x[q])
            walk_ = d1[:, cell // len(self.c2)] + d2[:, cell % len(self.c2)]
            for i in own:
                place.append(np.searchsorted(np.sort(walk_[i]), walk_[i][top[i]], side="right") / len(x))
        return float(np.quantile(np.concatenate(place), target))


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
    """Non-empty cells by summed distance until they hold ``least`` entries; cell = word1 * len(d2) + word2."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    held_by = counts.reshape(len(d1), len(d2))[np.ix_(o1, o2)].tolist()
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        if held_by[i][j]:
            out.append(int(o1[i]) * len(d2) + int(o2[j]))
            held += held_by[i][j]
        # (i, j + 1) follows (i, j); a new row begins at its first column
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def deal(counts: np.ndarray, order: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of each cell, the first part's number, and each part's bucket: runs of cells in ``order`` that hold about as many rows."""
    share = max(1, -(-int(counts.sum()) // buckets))
    parts = np.maximum(1, -(-counts // max(1, share // 2)))
    first = np.cumsum(parts) - parts
    size = np.repeat(counts / parts, parts)
    turn = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in order])
    middle = np.cumsum(size[turn]) - size[turn] / 2
    bucket = np.zeros(len(size), np.int64)
    bucket[turn] = np.minimum(middle * buckets / max(1, counts.sum()), buckets - 1).astype(np.int64)
    return parts, first, bucket


def along(centres: np.ndarray) -> np.ndarray:
    """Places of the centroids along the direction in which they vary most."""
    if not centres.shape[1]:
        return np.zeros(len(centres), np.int64)
    flat = centres - centres.mean(0)
    return np.argsort(np.argsort(flat @ np.linalg.svd(flat, full_matrices=False)[2][0], kind="stable"), kind="stable")


def shortlist_size(rows: int, k_nearest: int) -> int:
    return max(8 * k_nearest, int(np.ceil(1.2 * k_nearest * rows**0.25)))


def words_for(rows: int) -> int:
    return next((words for most, words in WORDS if rows <= most), MOST_WORDS)


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k_nearest: int = 10,
    words: int | None = None,
    sample: int = SAMPLE,
    target: float = TARGET,
    shortlist: int | None = None,
    seed: int = 13,
    touched: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to each row of ``vectors`` that ``is_query`` marks.

    ``shortlist`` entries a query and bucket, or a quarter of them if that is more, are reranked; by default ``shortlist_size`` of the number of rows.
    ``touched`` counts the entries whose codes are compared.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )
    out_schema = "query_id long, rank int, vec_id long, score double"
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size("v") == usual["d"])
    taken = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).toArrow()
    book = Codebooks(matrix(taken.column("v").combine_chunks()), words or words_for(usual["count"]), seed, k_nearest, target)
    keep = shortlist or shortlist_size(usual["count"], k_nearest)

    def place():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = book.scaled(matrix(batch.column(2)))
            cell = book.cells(x)
            codes = book.codes(x, cell)
            made = [pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(book.rests(cell, codes))]
            return pa.record_batch([*batch.columns, *made], names=["row", "vec_id", "v", "is_query", "cell", "codes", "rest"])

        return step

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "is_query")
    index = written(map_batches(numbered, place, "row long, vec_id long, v array<double>, is_query boolean, cell long, codes binary, rest double"), "multi-index")
    counts = np.zeros(len(book.c1) * len(book.c2), np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # at most one row for each cell
        counts[cell] = n
    least = int(np.ceil(book.share * counts.sum()))
    buckets = max(shuffle_partitions(spark), -(-int(counts.sum()) // BUCKET_ROWS))
    in_order = np.lexsort((np.tile(along(book.c2), len(book.c1)), np.repeat(along(book.c1), len(book.c2))))
    parts, first, of_part = deal(counts, in_order, buckets)
    names = ["bucket", "asks", "row", "vec_id", "cell", "part", "codes", "rest", "probes", "v"]

    def entries():
        def step(batch: pa.RecordBatch):
            cell = np.asarray(batch.column(2))
            part = first[cell] + (np.asarray(batch.column(0)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            cols = [pa.array(of_part[part].astype(np.int32)), pa.array(np.zeros(batch.num_rows, np.int8)), batch.column(0), batch.column(1), batch.column(2), pa.array(part), batch.column(3), batch.column(4), none, batch.column(5)]
            yield pa.record_batch(cols, names=names)

        return step

    def asks():
        def step(batch: pa.RecordBatch):
            x = book.scaled(matrix(batch.column(2)))
            d1, d2 = book.to_words(x)
            who, where, probes = [], [], []
            for k in range(len(x)):
                p = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in walk(d1[k], d2[k], counts, least)])
                order = np.argsort(of_part[p], kind="stable")
                b = of_part[p][order]
                for group in np.split(order, np.flatnonzero(b[1:] != b[:-1]) + 1):
                    who.append(k)
                    where.append(of_part[p[group[0]]])
                    probes.append(np.sort(p[group]))
            at, n = pa.array(np.array(who)), len(who)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            cols = [pa.array(np.array(where, np.int32)), pa.array(np.ones(n, np.int8)), batch.column(0).take(at), batch.column(1).take(at), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), raw.take(at), pa.nulls(n, pa.float64()), pa.array(probes, pa.list_(pa.int64())), batch.column(2).take(at)]
            yield pa.record_batch(cols, names=names)

        return step

    def rank(batches):
        """The entries of a bucket come first; then its queries, batch by batch, each compared with its probes."""
        held, ready = [], False
        for batch in batches:
            asking = np.asarray(batch.column(1)).astype(bool)
            n = int((~asking).sum())
            if n:
                e = batch.slice(0, n)
                held.append((*(np.asarray(e.column(c)) for c in (2, 3, 4, 5, 7)), np.frombuffer(b"".join(e.column(6).to_pylist()), np.uint8).reshape(n, -1), matrix(e.column(9))))
            q = batch.slice(n)
            if not q.num_rows or not (held or ready):
                continue
            if not ready:
                row, ids, cell, part, rest, codes, x = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((row, ids, part))
                row, ids, cell, part, rest, x = row[order], ids[order], cell[order], part[order], rest[order], x[order]
                codes, ready, held = np.ascontiguousarray(codes[order].T), True, []
            for at in range(0, q.num_rows, 64):
                some = q.slice(at, 64)
                v = np.frombuffer(b"".join(some.column(6).to_pylist()), np.float64).reshape(some.num_rows, -1)
                (d1, d2), tables = book.to_words(v), book.tables(v)
                whole, asked = some.column(2).to_pylist(), matrix(some.column(9))
                found, scores = [], []
                for k, probes in enumerate(some.column(8)):
                    probes = np.asarray(probes.values)
                    a, b = np.searchsorted(part, probes), np.searchsorted(part, probes, side="right")
                    idx = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
                    idx = idx[row[idx] != whole[k]]
                    rough = d1[k][cell[idx] // len(book.c2)] + d2[k][cell[idx] % len(book.c2)] + rest[idx]
                    for own, table in zip(codes, tables):
                        rough -= table[k][own[idx]]
                    if touched is not None:
                        touched.add(len(idx))
                    most = max(keep, -(-len(idx) // RERANKED))
                    if len(idx) > most:
                        near = np.flatnonzero(rough <= np.partition(rough, most - 1)[most - 1])
                        idx = idx[near[np.lexsort((row[idx[near]], ids[idx[near]], rough[near]))[:most]]]
                    score = distances(x[idx], asked[k])
                    near = np.lexsort((row[idx], ids[idx], score))[:k_nearest]
                    found.append(idx[near])
                    scores.append(score[near])
                of, idx = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
                yield pa.record_batch(
                    [some.column(2).take(pa.array(of)), some.column(3).take(pa.array(of)), pa.array(row[idx]), pa.array(ids[idx]), pa.array(np.concatenate(scores))],
                    names=["query", "query_id", "row", "vec_id", "score"],
                )

    kinds = "bucket int, asks byte, row long, vec_id long, cell long, part long, codes binary, rest double, probes array<long>, v array<double>"
    spread = map_batches(index.select("row", "vec_id", "cell", "codes", "rest", "v"), entries, kinds).unionByName(
        map_batches(index.where("is_query").select("row", "vec_id", "v"), asks, kinds)
    )
    found = spread.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("asks").mapInArrow(rank, "query long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
