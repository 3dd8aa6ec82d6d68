"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are computed from all shingles of the whole text, repeats
included.  Linking never compares all pairs: each distinct fingerprint goes to
15 tables, one for each choice of two of six bit segments.  Two fingerprints at
4 or fewer differing bits damage at most four segments, so at least one table
has both in one bucket (equal leading segments).  In a bucket the fingerprints,
bits permuted so that the equal segments lead, form a sorted array that is read
as a binary trie; pairs of nodes are walked together, differing bits add up, and
a pair is dropped once it exceeds the error budget or when both nodes already
lie in one component.  A bucket returns a spanning forest, not its pairs; one
with too many rows for a task is dealt anew by further bits.

Defined cases: a text of any length counts whole; null or blank text has fingerprint zero and is linked like any
other; equal texts share a fingerprint; repeated rows are repeated in the
result; a null doc_id keeps its row and takes no part in the smallest id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents_of, map_batches, shuffle_partitions
from .textarrays import mixed

SEGMENTS = (11, 11, 11, 11, 10, 10)
MAX_BITS = 4
CHUNK_ROWS = 500_000
#: Rows of the largest bucket that one task solves; larger ones are dealt anew.
BUCKET_ROWS = 200_000
#: Edges of a graph that one task unites.
FEW_EDGES = 1_000_000


def shingle_hashes(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; a text of fewer words is one shingle, a blank one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - words_per_shingle + 1].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    return majority(shingle_hashes(text, words_per_shingle, seed))


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [fingerprint(t.as_py(), words_per_shingle, seed) for t in batch.column(1)]
            return pa.record_batch(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

        return step

    return map_batches(documents_of(docs), make, "doc_id long, fp long")


def tables() -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For each table: bits of its bucket key, and the moves (from, to, width) that put its segments first."""
    starts = np.cumsum((0, *SEGMENTS))
    out = []
    for pair in combinations(range(len(SEGMENTS)), 2):
        order = [*pair, *(s for s in range(len(SEGMENTS)) if s not in pair)]
        moves, at = [], 0
        for s in order:
            moves.append((int(starts[s]), at, SEGMENTS[s]))
            at += SEGMENTS[s]
        out.append((SEGMENTS[pair[0]] + SEGMENTS[pair[1]], moves))
    return out


def permuted(fps: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros_like(fps)
    for at, to, width in moves:
        seg = (fps >> np.uint64(64 - at - width)) & np.uint64((1 << width) - 1)
        out |= seg << np.uint64(64 - to - width)
    return out


def _settle(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest index, with full path compression, in place."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def trie_forest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int = MAX_BITS) -> np.ndarray:
    """Component roots of sorted distinct ``values`` under links of at most ``budget`` bits.

    The nodes [start, end) are tries that share their first ``depth`` bits.
    Returns for each value the index of the smallest value of its component.
    """
    parent = np.arange(len(values))
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    changes = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1]))) if len(values) else parent
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if not len(al):
            continue
        if len(al) > 1 << 16:
            half = len(al) // 2
            stack.append((d, al[half:], ah[half:], bl[half:], bh[half:], err[half:]))
            al, ah, bl, bh, err = (x[:half] for x in (al, ah, bl, bh, err))
            stack.append((d, al, ah, bl, bh, err))
            continue
        joined = (changes[al] == changes[ah - 1]) & (changes[bl] == changes[bh - 1]) & (parent[al] == parent[bl])
        small = ((ah - al) * (bh - bl) <= 32) & ~joined
        if small.any():
            na, nb = (ah - al)[small], (bh - bl)[small]
            size = na * nb
            of = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = al[small][of] + k // nb[of], bl[small][of] + k % nb[of]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                found.append((i[near], j[near]))
                held += int(near.sum())
                if held > 200_000:
                    _settle(parent, *(np.concatenate(x) for x in zip(*found)))
                    found, held = [], 0
                    changes = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
        rest = ~small & ~joined
        if d >= 64 or not rest.any():
            continue
        al, ah, bl, bh, err = (x[rest] for x in (al, ah, bl, bh, err))
        bit = np.uint64(63 - d)

        def middle(lo, hi):
            at = ((values[lo] >> bit) | np.uint64(1)) << bit
            return np.clip(np.searchsorted(values, at), lo, hi)

        am, bm = middle(al, ah), middle(bl, bh)
        same = al == bl
        cross = err < budget
        parts = [
            (al, am, bl, bm, err, np.ones(len(al), bool)),
            (am, ah, bm, bh, err, np.ones(len(al), bool)),
            (al, am, bm, bh, err + 1, cross),
            (am, ah, bl, bm, err + 1, cross & ~same),
        ]
        cols = [np.concatenate([p[c][p[5] & (p[1] > p[0]) & (p[3] > p[2])] for p in parts]) for c in range(5)]
        lone = (cols[0] == cols[2]) & (cols[1] - cols[0] == 1)
        stack.append((d + 1, *(c[~lone] for c in cols)))
    if found:
        _settle(parent, *(np.concatenate(x) for x in zip(*found)))
    return parent


def _spread(batch: pa.RecordBatch):
    """Rows (bucket, depth, pv, fp) of the 15 tables of a batch of fingerprints."""
    fp = np.asarray(batch.column("fp")).view(np.uint64)
    for at in range(0, len(fp), 50_000):
        part = fp[at : at + 50_000]
        for t, (bits, moves) in enumerate(tables()):
            pv = permuted(part, moves)
            yield _rows((pv >> np.uint64(64 - bits)).astype(np.int64) | (t << 22), np.full(len(pv), bits, np.int32), pv, part)


def _spread_again(batch: pa.RecordBatch):
    """Rows of a large bucket by five parts of the bits after its depth: links of 4 bits leave one part equal."""
    bucket, depth, pv, fp = (np.asarray(batch.column(c)) for c in ("bucket", "depth", "pv", "fp"))
    pv, fp = pv.view(np.uint64), fp.view(np.uint64)
    for d in np.unique(depth).tolist():
        of = depth == d
        edges = d + (64 - d) * np.arange(MAX_BITS + 2) // (MAX_BITS + 1)
        for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            moves = [(0, 0, d), (lo, d, hi - lo), (d, d + hi - lo, lo - d), (hi, hi, 64 - hi)]
            moved = permuted(pv[of], [m for m in moves if m[2]])
            lead = moved >> np.uint64(64 - d - (hi - lo)) & np.uint64((1 << (hi - lo)) - 1)
            key = mixed(mixed(bucket[of].view(np.uint64) + np.uint64(k + 1)) + lead)
            yield _rows(key.view(np.int64), np.full(len(moved), d + hi - lo, np.int32), moved, fp[of])


def _rows(bucket: np.ndarray, depth: np.ndarray, pv: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket), pa.array(depth), pa.array(pv.view(np.int64)), pa.array(fp.view(np.int64))], names=["bucket", "depth", "pv", "fp"])


def links(distinct: DataFrame, budget: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of distinct fingerprints ``fp`` whose components are those of all links.

    A bucket of over ``bucket_rows`` rows isn't solved in its task: its rows go
    back and are dealt anew by parts of the bits that the bucket doesn't fix, until
    buckets are small enough.  A bucket that fixes d bits has at most 2**(64 - d)
    distinct rows, so this ends.
    """
    assert budget <= MAX_BITS
    bucket_rows = max(bucket_rows, 32)  # more rows than that leave a bit for each part

    def join(batches):
        def solve(pieces):
            bucket, depth, pv, fp = (np.concatenate(x) for x in zip(*pieces))
            for d in np.unique(depth):
                of = depth == d
                b, v, f = bucket[of], pv[of].view(np.uint64), fp[of]
                # a forest needs values that ascend, which those of one table do
                falls = np.flatnonzero(v[1:] < v[:-1]) + 1
                for lo, hi in zip([0, *falls.tolist()], [*falls.tolist(), len(v)]):
                    starts = np.flatnonzero(np.concatenate(([True], b[lo + 1 : hi] != b[lo : hi - 1])))
                    root = trie_forest(v[lo:hi], starts, np.append(starts[1:], hi - lo), int(d), budget)
                    linked = root != np.arange(len(root))
                    if linked.any():
                        yield _found(f[lo:hi][linked], f[lo:hi][root[linked]])

        def back(pieces):
            for bucket, depth, pv, fp in pieces:
                yield pa.record_batch([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(bucket), pa.array(depth), pa.array(pv)], names=["a", "b", "bucket", "depth", "pv"])

        held: list[tuple[np.ndarray, ...]] = []  # rows of whole buckets but for the last, which may go on
        rows, last, last_rows = 0, None, 0
        for batch in batches:
            cols = tuple(np.asarray(batch.column(c)) for c in range(4))
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1, [len(cols[0])])).tolist()
            for lo, hi in zip(edges[:-1], edges[1:]):
                piece, key = tuple(c[lo:hi] for c in cols), int(cols[0][lo]) if hi > lo else last
                if key != last:
                    if last_rows > bucket_rows:
                        held, rows = [], 0
                    elif rows >= CHUNK_ROWS:
                        yield from solve(held)
                        held, rows = [], 0
                    last, last_rows, begin = key, 0, len(held)
                last_rows += hi - lo
                if last_rows <= bucket_rows:
                    held.append(piece)
                    rows += hi - lo
                else:
                    if last_rows - (hi - lo) <= bucket_rows:  # it has just become too large
                        if begin:
                            yield from solve(held[:begin])
                        yield from back(held[begin:])
                        held, rows = [], 0
                    yield from back([piece])
        if held:
            yield from solve(held)

    def _found(a, b):
        n = len(a)
        return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["a", "b", "bucket", "depth", "pv"])

    def solved(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(shuffle_partitions(distinct.sparkSession), "bucket").sortWithinPartitions("bucket", "pv")
        return cut(dealt.mapInArrow(join, "a long, b long, bucket long, depth int, pv long"))

    kinds = "bucket long, depth int, pv long, fp long"
    found = solved(map_batches(distinct.select("fp"), lambda: _spread, kinds))
    edges = found.where("b is not null").select("a", "b")
    while found.where("b is null").limit(1).count():
        again = found.where("b is null").select("bucket", "depth", "pv", F.col("a").alias("fp"))
        found = solved(map_batches(again, lambda: _spread_again, kinds))
        edges = edges.unionByName(found.where("b is not null").select("a", "b"))
    return edges.distinct()


def settled(edges: DataFrame) -> DataFrame:
    """(node, root) of a counted, small number of edges, in one task."""

    def run(batches):
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not parts:
            return
        a, b = (np.concatenate(c) for c in zip(*parts))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        parent = np.arange(len(nodes))
        _settle(parent, place[: len(a)], place[len(a) :])
        for at in range(0, len(nodes), 100_000):
            yield pa.record_batch([pa.array(nodes[at : at + 100_000]), pa.array(nodes[parent[at : at + 100_000]])], names=["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds until up to ``few`` edges are left or nothing
    changes; every round is checkpointed.  That few edges, 16 MB, are united in one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = sign(now)
    while last[0] > few:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        here = sign(now)
        if here == last:
            break
        last = here
    else:
        return settled(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def with_class(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``classes`` (key, class_size, ...) on ``key``, where few keys may hold most rows.

    Classes of over a ten-thousandth of all rows, of which there are at most ten
    thousand, are broadcast; the other rows are joined by shuffle.
    """
    large = F.col("class_size") > max(1_000, rows.count() // 10_000)
    hot = F.broadcast(classes.where(large))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(classes.where(~large), key))


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = 4, seed: int = 42, budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_size): one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, itself included;
    ``class_size`` counts the rows that share the fingerprint.
    """
    fps = cut(fingerprints(docs, words_per_shingle, seed))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size")))
    member = cut(components(links(classes, budget)).withColumnRenamed("node", "fp"))
    least = member.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    placed = classes.join(member.join(least, "root").select("fp", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "rep").alias("component_id"), "class_size"
    )
    return with_class(fps, cut(placed), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_size"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest doc_id."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is its component_id in ``found``.

    Rows without a doc_id stay; of rows that repeat a kept doc_id one stays.
    """
    found = found.where("doc_id is not null and doc_id = component_id")
    kept = cut(found.groupBy("doc_id").agg(F.count("*").alias("__copies")))
    rows = docs.join(kept, docs["doc_id"].cast("long") == kept["doc_id"], "left_semi")
    twice = kept.where("__copies > 1")
    if twice.limit(1).count():
        again = F.broadcast(twice) if twice.count() < 10_000 else twice
        single = rows.join(again, rows["doc_id"].cast("long") == again["doc_id"], "left_anti")
        repeated = rows.join(again, rows["doc_id"].cast("long") == again["doc_id"], "left_semi").dropDuplicates(["doc_id"])
        rows = single.unionByName(repeated)
    return rows.unionByName(docs.where("doc_id is null"))
