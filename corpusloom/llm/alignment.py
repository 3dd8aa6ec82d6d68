"""Alignment of two tokenizers' tokens over a corpus.

Both tokenizers cut the same bytes, a space and the text, so the tokens that overlap are
those of the finest common cutting: every place at which either cuts ends a cell, and a cell
is the link of one A token and one B token.

A task encodes its texts in slices and counts the id pairs of each document.  Pair counts of
the corpus come from sums by slice, which are added up by pair.  Then slices' postings (pair,
document, times) and the pair counts meet in a cogroup: both are dealt by B id, in ranges that
hold about as many postings each, a B id with more than a range's share over several of them
with its counts in each.  A range is sorted by stream (Spark spills where it must), the counts
first; these give every pair's count and the highest of its B id, and postings pass by and
leave the shares of a slice's documents, which are summed by document.

Defined cases: null and empty texts, and texts that hold U+2581 (its joined B bytes are a
space, not the text's), have no tokens, zeros and an empty digest; strings of special tokens
in a text are plain text; repeated rows count and are returned each; texts of any length are
aligned whole; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, documents_of, flat_bytes, map_batches, shuffle_partitions, slices, written
from .pieces import SPACE, PieceEncoder, decimals, flat_of, spaced

#: B id above the A id in a pair's key.
SHIFT = 20
#: Rows of a slice at most, so that places in it are 16 bits.
MOST_ROWS = 50_000

SLICE = (
    "first_row long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "pairs array<long>, pair_times array<long>, pair_docs array<long>, docs binary, times binary"
)
STREAM = "part int, stream byte, first_row long, pairs binary, counts binary, docs binary, times binary"
SHARES = "first_row long, docs binary, n_best binary, count_sum binary"
FACTS = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")
RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Cells:
    """The common cutting of texts by two tokenizers; texts are given as flat bytes that both cut."""

    def __init__(self, ids_a: np.ndarray, off_a: np.ndarray, len_a: np.ndarray, ids_b: np.ndarray, off_b: np.ndarray, len_b: np.ndarray):
        self.ids_a, self.off_a, self.ids_b, self.off_b = ids_a.astype(np.int64), off_a, ids_b.astype(np.int64), off_b
        self.ends_a, self.ends_b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
        total = int(self.ends_a[-1]) if len(ids_a) else 0
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[self.ends_a] = True
        at_b[self.ends_b] = True
        self.cells = np.flatnonzero(at_a | at_b)
        self.a_of = (np.cumsum(at_a, dtype=np.int32) - at_a)[self.cells]
        self.b_of = (np.cumsum(at_b, dtype=np.int32) - at_b)[self.cells]
        self.common = np.flatnonzero(at_a & at_b)

    def pairs(self) -> np.ndarray:
        return self.ids_b[self.b_of] << SHIFT | self.ids_a[self.a_of]

    def by_text(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many of the sorted byte ends ``at`` lie in each text."""
        return np.diff(np.searchsorted(at, bounds, side="right"))

    def described(self, bounds: np.ndarray) -> list[str]:
        """The digest of each text's groups, A ids before B ids; empty without tokens."""
        upto_a = np.searchsorted(self.ends_a, self.common, side="right")
        upto_b = np.searchsorted(self.ends_b, self.common, side="right")
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        place_a = np.arange(len(self.ids_a)) + np.repeat(upto_b - n_b, n_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(upto_a, n_b)
        ids = np.empty(len(place_a) + len(place_b), np.int64)
        marks = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        marks[place_a[upto_a - 1]] = ord("|")
        marks[place_b[upto_b - 1]] = ord(";")
        listed, widths = flat_of(*decimals(1 << SHIFT - 4), ids)
        ends = np.cumsum(widths)
        listed[ends - 1] = marks
        edges = np.concatenate(([0], ends))[self.off_a + self.off_b].tolist()
        view = memoryview(listed)
        return [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(edges, edges[1:])]


def counted(pairs: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs and their texts: distinct pairs, how often each is in all and in how many texts, and those texts and times."""
    if not len(pairs):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    both, times = np.unique(pairs << 16 | text, return_counts=True)
    pair = both >> 16
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[first], np.add.reduceat(times, first), np.diff(np.append(first, len(pair))), both & 0xFFFF, times


def sliced(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row for each slice of texts: its documents with their numbers of tokens, and their postings by pair."""

    def make():
        byte_level, by_pieces = bpe.Encoder(byte_path, special=False), PieceEncoder(piece_path)
        len_a, len_b = np.diff(byte_level.vocab.byte_offsets), np.diff(by_pieces.vocab.byte_offsets)
        if max(len(len_a), len(len_b)) > 1 << SHIFT - 4:
            raise ValueError(f"ids of {1 << SHIFT - 4} and more aren't expected")

        def lists(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int64)))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in (p.slice(k, MOST_ROWS) for p in slices(batch, "text") for k in range(0, p.num_rows, MOST_ROWS)):
                texts = pc.fill_null(part.column("text"), "")
                data, bounds = spaced(*flat_bytes(pc.if_else(pc.match_substring(texts, SPACE), "", texts)))
                found = Cells(*byte_level(data, bounds), len_a, *by_pieces.encode_spaced(data, bounds), len_b)
                text = np.searchsorted(bounds, found.cells, side="left") - 1
                pairs, in_all, in_docs, where, times = counted(found.pairs(), text)
                yield pa.record_batch(
                    [
                        part.column("row").slice(0, 1),
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                        lists(np.diff(found.off_a)),
                        lists(np.diff(found.off_b)),
                        lists(found.by_text(found.common, bounds)),
                        lists(found.by_text(found.cells, bounds)),
                        pa.array([found.described(bounds)], pa.list_(pa.string())),
                        lists(pairs),
                        lists(in_all),
                        lists(in_docs),
                        pa.array([where.astype("<u2").tobytes()], pa.binary()),
                        pa.array([times.astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=[c.split()[0] for c in SLICE.split(", ")],
                )

        return step

    rows = documents_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_batches(rows, make, SLICE)


def ranges(sizes: dict[int, int], n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of B ids of about equal numbers of postings: the ids, each one's first range, and over how many it goes."""
    ids = np.array(sorted(sizes), np.int64)
    size = np.array([sizes[b] for b in ids.tolist()], np.int64)
    ends = np.cumsum(size)
    share = max(1, -(-int(ends[-1]) // n_parts))
    first, last = (ends - size) // share, (ends - 1) // share
    return ids, first, last - first + 1


def summed(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """Each document's facts with the sums of its shares; a slice's documents are summed together."""

    def run(key, slice_: pa.Table, given: pa.Table) -> pa.Table:
        columns = {c: slice_.column(c).combine_chunks().flatten() for c in FACTS}
        best, total = (np.zeros(len(columns["doc_ids"]), np.int64) for _ in range(2))
        for docs, more, sums in zip(*(given.column(c).to_pylist() for c in ("docs", "n_best", "count_sum"))):
            where = np.frombuffer(docs, "<u2")  # each document once
            best[where] += np.frombuffer(more, "<i8")
            total[where] += np.frombuffer(sums, "<i8")
        *numbers, digests = columns.values()
        return pa.table([*numbers, pa.array(best), pa.array(total), digests], names=list(RESULT))

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULT)
    return parts.select("first_row", *FACTS).groupBy("first_row").cogroup(shares.groupBy("first_row")).applyInArrow(run, schema)


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    parts = written(sliced(docs, byte_path, piece_path), "alignment")
    zipped = F.explode(F.arrays_zip("pairs", "pair_times", "pair_docs"))
    counts = cut(
        parts.select(zipped.alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_times").alias("times"), F.sum("p.pair_docs").alias("n_docs"))
    )
    # one row for each B id, of which a vocabulary has a fixed number
    by_b = counts.groupBy(F.shiftrightunsigned("pair", SHIFT).alias("b")).agg(F.sum("n_docs").alias("n")).toArrow()
    sizes = dict(zip(by_b.column("b").to_pylist(), by_b.column("n").to_pylist()))
    if not sizes:
        return summed(parts, spark.createDataFrame([], SHARES))
    n_parts = shuffle_partitions(spark)
    ids, first, spread = ranges(sizes, n_parts)
    names = [c.split()[0] for c in STREAM.split(", ")]

    def message(part: int, stream: int, row: int, pairs: np.ndarray, counts: np.ndarray, docs: np.ndarray | None = None, times: np.ndarray | None = None) -> tuple:
        return part, stream, row, pairs.tobytes(), counts.astype("<i8").tobytes(), None if docs is None else docs.tobytes(), None if times is None else times.tobytes()

    def batch_of(messages: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*messages), kinds)], names=names)

    def runs(keys: np.ndarray) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        return list(zip(edges, [*edges[1:], len(keys)]))

    def deal_counts():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            pair, times = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            at = np.searchsorted(ids, pair >> SHIFT)
            again = spread[at]
            part = np.repeat(first[at] - np.cumsum(again) + again, again) + np.arange(again.sum())
            pair, times = np.repeat(pair, again), np.repeat(times, again)
            order = np.argsort(part, kind="stable")
            part, pair, times = part[order], pair[order], times[order]
            yield batch_of([message(int(part[a]), 0, 0, pair[a:b], times[a:b]) for a, b in runs(part)])

        return step

    def deal_postings():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for k in range(batch.num_rows):
                row = batch.column(0)[k].as_py()
                pair, n_docs = (np.asarray(batch.column(c)[k].values, dtype=np.int64) for c in (1, 2))
                if not len(pair):
                    continue
                where, times = np.frombuffer(batch.column(3)[k].as_py(), "<u2"), np.frombuffer(batch.column(4)[k].as_py(), "<u4")
                at = np.searchsorted(ids, pair >> SHIFT)
                turn = (row * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33
                part = first[at] + turn % spread[at]
                edges = np.concatenate(([0], np.cumsum(n_docs)))
                made = []
                for a, b in runs(part):  # a B id that goes over several ranges may set neighbours apart
                    own = slice(edges[a], edges[b])
                    made.append(message(int(part[a]), 1, row, pair[a:b], n_docs[a:b], where[own], times[own]))
                yield batch_of(made)

        return step

    def cogroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per range the counts come first, then the postings, message by message."""
        now, held, table = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                part, stream, row = (batch.column(c)[k].as_py() for c in range(3))
                pair, number = (np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in (3, 4))
                if part != now:
                    now, held, table = part, [], None
                if stream == 0:
                    held.append((pair, number))
                    continue
                if table is None:
                    pairs, counts_ = (np.concatenate(c) for c in zip(*held))
                    order = np.argsort(pairs)
                    pairs, counts_ = pairs[order], counts_[order]
                    begins = np.flatnonzero(np.concatenate(([True], pairs[1:] >> SHIFT != pairs[:-1] >> SHIFT)))
                    most = np.repeat(np.maximum.reduceat(counts_, begins), np.diff(np.append(begins, len(pairs))))
                    table, held = (pairs, counts_, counts_ == most), []
                at = np.searchsorted(table[0], pair)
                where, times = np.frombuffer(batch.column(5)[k].as_py(), "<u2").astype(np.int64), np.frombuffer(batch.column(6)[k].as_py(), "<u4").astype(np.int64)
                best, total = np.zeros(int(where.max()) + 1, np.int64), np.zeros(int(where.max()) + 1, np.int64)
                np.add.at(best, where, times * np.repeat(table[2][at], number))
                np.add.at(total, where, times * np.repeat(table[1][at], number))
                full = np.flatnonzero(total)
                out.append((row, full.astype("<u2").tobytes(), best[full].tobytes(), total[full].tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["first_row", "docs", "n_best", "count_sum"])

    streams = map_batches(counts.select("pair", "times"), deal_counts, STREAM).unionByName(
        map_batches(parts.select("first_row", "pairs", "pair_docs", "docs", "times"), deal_postings, STREAM)
    )
    met = streams.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "stream").mapInArrow(cogroup, SHARES)
    return summed(parts, met)
