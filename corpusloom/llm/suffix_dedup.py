"""Exact substring removal with a sparse, range-partitioned suffix array.

A byte goes if a string of ``window`` bytes that covers it also starts in a
document with a smaller id.  Ranking the suffixes of every position would move
each byte dozens of times, so suffixes are taken at anchors only: the anchor of a
window is its ``gram``-byte string of least hash, leftmost of equals, so equal
windows have their anchor, and all bytes around it, in common.  Consecutive
windows with one anchor form a block, which about fifteen positions share.

1. Documents are dealt to chunks by a hash, as many chunks as the bytes of all texts
   ask for; a chunk is one partition.
2. Each chunk sends, by ranges of the bytes at its anchors, the distinct anchor
   hashes; a range finds those that two documents share and tells their chunks.
3. Each chunk sends the distinct blocks at shared anchors, with the smallest
   document that has them, to the same ranges.  The ranges' splitters are quantiles
   of sampled suffixes and lie between different leading words, so no equal
   suffixes stand on both sides of a boundary.
4. A range sorts its suffixes, and then the windows at them, by multikey
   quicksort over 8-byte words (a word is sorted only within runs that are equal
   so far) and compares neighbours: a run of equal windows gets the smallest
   document of the run.  Windows are compared byte by byte; the anchor hash only
   saves work.
5. Chunks get, for each of their blocks, the smallest document of every window and
   remove the windows whose document is smaller than the one at hand.

What a chunk sends is distinct within it, so a passage in a third of all
documents costs a range one entry a chunk; nothing is ever sent for each copy.
Where such a passage ends, every document goes on in its own way, so the blocks
there are as many as the documents.  Anchors that over ``hot_chunks`` chunks share
are therefore sent window by window, dealt by a hash of the whole window instead
of by range: equal windows still meet, the others spread over all tasks.  A large
group of one range is compared one anchor place at a time.
Steps 2 to 5 read the chunks from one shuffle of the documents.

Defined cases: null text is empty; a document of fewer than ``window`` bytes
keeps them all; matches never cross documents; equal ids are one document, whose
rows don't remove each other's bytes; rows without an id count as the largest
document and keep strings they alone have; a text of any length counts whole and is
cut into pieces only for work; an empty table gives an empty result; other columns,
whatever their names, are ignored by ``remove_repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_bytes, release, shuffle_partitions
from .textarrays import mixed

WINDOW = 50
GRAM = 20
SEGMENT = 1 << 18
SLAB = 150_000
HOT_CHUNKS = 256
PLACE_BITS = np.uint64(20)
HASH_BITS = 40
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
#: Bytes of text of a chunk, about, and suffixes that the splitters are sampled from.
CHUNK_BYTES = 64 << 20
SAMPLE = 100_000
#: Bytes of blocks, and documents, that a chunk turns into rows at a time.
SENT_BYTES = 4 << 20
KEPT_ROWS = 256
NO_ID = np.iinfo(np.int64).max


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from every place on, by doubling."""
    n = len(buf) - k + 1
    part, size = buf.astype(np.uint64) + np.uint64(1), 1
    out, at = np.zeros(n, np.uint64), 0
    while True:
        if k & size:
            out = mixed(out + part[at : at + n])
            at += size
        if 2 * size > k:
            return out
        part = mixed(part[:-size] * np.uint64(BASE) + part[size:])
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


@lru_cache(2)
def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(base, -1, 1 << 64))
    return np.cumprod(np.full(n, np.uint64(base))), np.cumprod(np.full(n, inverse))


class Blocks:
    """The blocks of a piece of a chunk: runs of windows with one anchor."""

    def __init__(self, buf: np.ndarray, valid: np.ndarray, window: int, gram: int):
        n = len(valid)
        h = gram_hashes(buf, gram)
        place = np.uint64((1 << int(PLACE_BITS)) - 1)
        least = sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), window - gram + 1)[:n]
        at = (least & place).astype(np.int64)
        edge = np.ones(n + 1, bool)
        edge[1:n] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(edge[:-1])
        size = np.diff(np.append(start, n))
        ok = valid[start]
        self.start, self.size = start[ok], size[ok]
        self.anchor = at[self.start]
        self.left = self.anchor - self.start
        self.gram_hash = h[self.anchor] >> np.uint64(64 - HASH_BITS)
        self.length = self.size + window - 1
        self.buf, self.totals = buf, {}

    def digests(self, start: np.ndarray, length: np.ndarray, base: int = BASE) -> np.ndarray:
        """64 bits of the bytes from ``start`` on, ``length`` each."""
        power, inverse = powers(SEGMENT + 4096, base)
        if base not in self.totals:
            self.totals[base] = np.concatenate(([np.uint64(0)], np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[: len(self.buf)])))
        total = self.totals[base]
        return mixed((total[start + length] - total[start]) * inverse[start])

    def fingerprints(self, of: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of each block's bytes and its anchor's place, and 32 bits more by another base."""
        start, length = self.start[of], self.length[of]
        mark = mixed(self.digests(start, length) + self.left[of].astype(np.uint64) * np.uint64(256) + self.size[of].astype(np.uint64))
        return mark, (self.digests(start, length, OTHER_BASE) >> np.uint64(32)).astype(np.uint32)

    def leading(self) -> np.ndarray:
        """The first 8 bytes at each anchor as a number that sorts like them."""
        return big_endian(self.buf)[self.anchor]


def big_endian(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as numbers that sort like the bytes."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), ">u8", padded.data, strides=(1,)).astype(np.uint64)


class Chunk:
    """The documents of one chunk, sorted by id, as one byte string."""

    def __init__(self, table: pa.Table):
        ids = np.asarray(pc.fill_null(table.column("doc_id"), NO_ID).combine_chunks()) if table.num_rows else np.zeros(0, np.int64)  # one small column
        order = np.argsort(ids, kind="stable")
        self.order = order
        self.ids = ids[order]
        self.null_id = np.asarray(table.column("doc_id").is_null())[order] if table.num_rows else np.zeros(0, bool)
        text = table.column("text").take(pa.array(order)).combine_chunks() if table.num_rows else pa.array([], pa.string())
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        self.buf, self.offsets = flat_bytes(text)
        del text
        release()

    def pieces(self, window: int, gram: int):
        """(first place, blocks, document of each block), with whole windows only."""
        if len(self.buf) < window:
            return
        n = len(self.buf) - window + 1
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            valid = np.ones(b - a, bool)
            first, last = np.searchsorted(self.offsets, [a, b + window], side="left")
            for end in self.offsets[first : last + 1].tolist():  # windows that reach over a document's end
                lo, hi = end - window + 1 - a, end - a
                if hi > 0 and lo < b - a:
                    valid[max(0, lo) : max(0, hi)] = False
            blocks = Blocks(self.buf[a : b + window - 1], valid, window, gram)
            if len(blocks.start):
                # a block must not reach from one document to the next
                yield a, blocks, np.searchsorted(self.offsets, a + blocks.start, side="right") - 1


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, and whether each row (in that order) equals the one before.

    Sorts by the first word; each further word is sorted only within runs of rows
    that are equal so far.
    """
    n, m = words.shape
    order = np.argsort(words[:, 0], kind="quicksort")
    same = np.zeros(n, bool)
    same[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for c in range(1, m):
        run = np.flatnonzero(same | np.append(same[1:], False))
        if not len(run):
            break
        group = np.cumsum(~same)[run]
        key = words[order[run], c]
        inner = np.lexsort((key, group))
        order[run] = order[run][inner]
        key = key[inner]
        equal = np.zeros(len(run), bool)
        equal[1:] = key[1:] == key[:-1]
        same[run] &= equal
    return order, same


def to_planes(sorted_hashes: np.ndarray) -> bytes:
    """Sorted numbers as the byte planes of their differences, which compress well."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return gaps[:, : HASH_BITS // 8].T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(HASH_BITS // 8, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, : HASH_BITS // 8] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def _split(bucket: np.ndarray):
    """(bucket, rows) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    for rows in np.split(order, starts[1:]) if len(b) else []:
        yield int(bucket[rows[0]]), rows


def routes(spark, n: int) -> DataFrame:
    """(slot, chunk) for the slots 0 to n - 1: a number that hash partitioning sends to a partition of its own."""
    ids = spark.range(64 * n + 1000).select(F.col("id").cast("int").alias("id"))
    return ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("slot")).agg(F.min("id").alias("chunk"))


def splitters(docs: DataFrame, n: int) -> np.ndarray:
    """n - 1 quantiles of the leading 8 bytes of one suffix of each of a sample of documents."""
    raw = F.col("text").cast("binary")
    size = F.octet_length("text")
    at = (F.pmod(F.xxhash64("doc_id", size), F.greatest(size - 8, F.lit(1))) + 1).cast("int")
    lead = F.substring(raw, at, F.lit(8)).alias("lead")
    found = docs.where(size >= 8).select(lead, F.xxhash64("doc_id", at, size).alias("u")).orderBy("u", "lead").limit(max(SAMPLE, 4 * n)).toArrow()
    leads = np.sort(np.frombuffer(b"".join(found.column("lead").to_pylist()), ">u8").astype(np.uint64))
    return np.unique(leads[(np.arange(1, n) * len(leads)) // n]) if len(leads) else leads


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, carry: tuple[str, ...] = (), hot_chunks: int = HOT_CHUNKS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept_text] [, carried]): one row for each row of ``docs``.

    ``kept_text`` leaves out bytes of characters that the removal has cut; ``carried`` is a
    struct of the columns that ``carry`` names, so their names can't clash with these.
    """
    if not 1 <= gram <= window or window - gram + WINDOW > 250:
        raise ValueError("gram must lie between 1 and window, and windows under 200 bytes")
    spark = docs.sparkSession
    held = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *held)
    carry = ("carried",) if carry else ()
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-n_bytes // chunk_bytes))
    split_at = splitters(docs, n)
    slot = F.pmod(F.hash("doc_id", "text"), F.lit(n))  # rows of one id, or of none, spread
    dealt = docs.withColumn("slot", slot).join(F.broadcast(routes(spark, n)), "slot", "left")
    chunks = dealt.select(F.coalesce("chunk", "slot").alias("chunk"), "doc_id", "text", *carry).repartition(n, "chunk")

    def ask(batches):
        """Step 2: a chunk's distinct anchor hashes by range, and which of them two of its documents share."""
        release()
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        chunk = table.column("chunk")[0].as_py()
        hashes, docs_, buckets = [], [], []
        whole = Chunk(table)
        for _, blocks, of in whole.pieces(window, gram):
            hashes.append(blocks.gram_hash)
            docs_.append(whole.ids[of])
            buckets.append(np.searchsorted(split_at, blocks.leading(), side="right"))
        if not hashes:
            return
        hashes, docs_, buckets = map(np.concatenate, (hashes, docs_, buckets))
        del whole, table, tables
        release()
        for bucket, rows in _split(buckets):
            order = rows[np.lexsort((docs_[rows], hashes[rows]))]
            h, d = hashes[order], docs_[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            last = np.append(first[1:], len(h)) - 1
            many = d[first] != d[last]
            yield pa.record_batch(
                [pa.array([bucket], pa.int32()), pa.array([chunk], pa.int32()), pa.array([to_planes(h[first])], pa.binary()), pa.array([np.packbits(many).tobytes()], pa.binary())],
                names=["bucket", "chunk", "hashes", "many"],
            )

    def shared(batches):
        """Step 2, in a range: tell each chunk which of its anchor hashes are shared."""
        by: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by.setdefault(row["bucket"], []).append((row["chunk"], from_planes(row["hashes"]), row["many"]))
        for rows in by.values():
            sizes = [len(h) for _, h, _ in rows]
            every = np.concatenate([h for _, h, _ in rows])
            many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k).astype(bool) for k, (_, _, m) in zip(sizes, rows)])
            order = np.argsort(every, kind="stable")
            h = every[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            group = np.cumsum(first) - 1
            holders = np.bincount(group)
            hit = (holders > 1) | (np.bincount(group, many[order]) > 0)
            open_, hot = np.empty(len(every), bool), np.empty(len(every), bool)
            open_[order], hot[order] = hit[group], (holders > hot_chunks)[group]
            at = 0
            for (chunk, own, _), k in zip(rows, sizes):
                pick = open_[at : at + k]
                mine, heat = own[pick], hot[at : at + k][pick]
                at += k
                if len(mine):
                    yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([to_planes(mine)], pa.binary()), pa.array([np.packbits(heat).tobytes()], pa.binary())], names=["chunk", "hashes", "hot"])

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 3: a chunk's distinct blocks at shared anchors, by range."""
        kinds = {"bucket": pa.int32(), "chunk": pa.int32()}
        names = ("bucket", "chunk", "size", "left", "shift", "least", "most", "mark", "check", "bytes")
        out, parts = {k: [] for k in names}, []

        def cut_off():
            """Turns what ``out`` holds into rows, so that bytes are there once."""
            parts.append(pa.table({k: pa.array(out[k], kinds.get(k, pa.binary())) for k in names}))
            for held in out.values():
                held.clear()

        release()
        if right.num_rows and left.num_rows:
            told_ = [from_planes(h) for h in right.column("hashes").to_pylist()]
            heat = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(right.column("hot").to_pylist(), told_)]).astype(bool)
            wanted = np.concatenate(told_)
            order = np.argsort(wanted)
            wanted, heat = wanted[order], heat[order]
            whole = Chunk(left)
            held = []
            for base, blocks, of in whole.pieces(window, gram):
                at = np.minimum(np.searchsorted(wanted, blocks.gram_hash), len(wanted) - 1)
                pick = np.flatnonzero(wanted[at] == blocks.gram_hash)
                if not len(pick):
                    continue
                (mark, check), place = blocks.fingerprints(pick), np.searchsorted(split_at, blocks.leading()[pick], side="right")
                start, size, lefts, shift, ids = blocks.start[pick], blocks.size[pick], blocks.left[pick], np.zeros(len(pick), np.int64), whole.ids[of[pick]]
                hot = heat[at[pick]]
                if hot.any():  # windows instead of blocks, to all tasks
                    k = np.flatnonzero(hot)
                    w = np.repeat(k, size[k])
                    j = np.arange(len(w)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
                    alone = blocks.digests(start[w] + j, np.full(len(w), window))
                    cold = np.flatnonzero(~hot)
                    join = lambda x, y: np.concatenate((x[cold], y))  # noqa: E731,B023
                    mark, check, place = join(mark, mark[w]), join(check, check[w]), join(place, (alone % np.uint64(n)).astype(np.int64))
                    start, lefts, shift, ids = join(start, start[w] + j), join(lefts, lefts[w] - j), join(shift, j), join(ids, ids[w])
                    size = join(size, np.ones(len(w), np.int64))
                order = np.lexsort((ids, shift, mark))
                m, sh, ch = mark[order], shift[order], check[order]
                first = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (sh[1:] != sh[:-1]) | (ch[1:] != ch[:-1]))))
                last = np.append(first[1:], len(m)) - 1
                k = order[first]
                small = (x.astype(np.uint8) for x in (sh[first], size[k], lefts[k]))
                held.append((place[k].astype(np.int32), m[first], ch[first], ids[k], ids[order[last]], base + start[k], *small))
            if held:
                columns = list(zip(*held))
                held.clear()
                bucket, mark, check, least, most, start, shift, size, lefts = (np.concatenate(columns.pop(0)) for _ in range(9))
                waits = 0
                for b, rows in _split(bucket):
                    # the same block may come from several pieces of the chunk
                    order = rows[np.lexsort((shift[rows], mark[rows]))]
                    m, sh, ch = mark[order], shift[order], check[order]
                    first = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (sh[1:] != sh[:-1]) | (ch[1:] != ch[:-1]))))
                    k = order[first]
                    length = size[k].astype(np.int64) + window - 1
                    text = whole.buf[np.repeat(start[k] - np.cumsum(length) + length, length) + np.arange(length.sum())]
                    out["bucket"].append(b)
                    out["chunk"].append(key[0].as_py())
                    out["size"].append(size[k].tobytes())
                    out["left"].append(lefts[k].tobytes())
                    out["shift"].append(sh[first].tobytes())
                    out["least"].append(np.minimum.reduceat(least[order], first).astype("<i8").tobytes())
                    out["most"].append(np.maximum.reduceat(most[order], first).astype("<i8").tobytes())
                    out["mark"].append(m[first].astype("<u8").tobytes())
                    out["check"].append(ch[first].astype("<u4").tobytes())
                    out["bytes"].append(text.tobytes())
                    waits += len(text)
                    if waits >= SENT_BYTES:
                        cut_off()
                        waits = 0
        cut_off()
        release()
        return pa.concat_tables(parts)

    def compare(batches):
        """Step 4: sort the suffixes and windows of each range; answer with the smallest document of every window."""
        release()
        by: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by.setdefault(row["bucket"], []).append(row)
        for rows in by.values():
            get = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])  # noqa: E731,B023
            size, left, shift = (get(x, np.uint8).astype(np.int64) for x in ("size", "left", "shift"))
            least, most, mark, check = get("least", "<i8"), get("most", "<i8"), get("mark", "<u8"), get("check", "<u4")
            chunk = np.repeat([r["chunk"] for r in rows], [len(r["size"]) for r in rows])
            padded = b"".join([*(r["bytes"] for r in rows), bytes(window + 8)])
            rows.clear()
            length = size + window - 1
            begin = np.cumsum(length) - length
            eight = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
            word = lambda at: eight[at].astype(np.uint64)
            steps = [*range(0, gram - 7, 8), gram - 8] if gram >= 8 else [0]
            anchor = begin + left
            heads = np.stack([word(anchor + s) for s in steps], 1) if gram >= 8 else np.stack([word(anchor) >> np.uint64(64 - 8 * gram)], 1)
            order, same = multikey_sort(heads)
            group = np.cumsum(~same) - 1
            sizes = np.bincount(group)
            lo, hi = np.full(len(sizes), NO_ID), np.full(len(sizes), np.iinfo(np.int64).min)
            np.minimum.at(lo, group, least[order])
            np.maximum.at(hi, group, most[order])
            order = order[(lo < hi)[group]]
            group = group[(lo < hi)[group]]
            n_windows = np.cumsum(size[order])
            del heads, same, anchor, length
            release()
            answers: dict[int, list] = {}

            def weigh(rec, first, last):
                """Windows ``first`` to ``last`` of blocks ``rec``: the smallest document of each."""
                k = last - first
                of = np.repeat(np.arange(len(rec)), k)
                place = (begin[rec] + first)[of] + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)  # noqa: B023
                steps_w = sorted({*range(0, window - 7, 8), max(0, window - 8)})
                words = np.stack([word(place + s) for s in steps_w], 1)  # noqa: B023
                if window < 8:
                    words >>= np.uint64(64 - 8 * window)
                w_order, w_same = multikey_sort(words)
                run = np.flatnonzero(~w_same)
                smallest = np.minimum.reduceat(least[rec][of[w_order]], run)  # noqa: B023
                found = np.empty(len(of), np.int64)
                found[w_order] = np.repeat(smallest, np.diff(np.append(run, len(of))))
                edge = np.ones(len(of), bool)
                edge[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
                starts = np.flatnonzero(edge)
                runs = np.diff(np.append(starts, len(of)))
                useful = found[starts] < most[rec][of[starts]]  # noqa: B023
                starts, runs = starts[useful], runs[useful]
                whose = rec[of[starts]]
                offset = place[starts] - begin[whose] + shift[whose]  # noqa: B023
                for c, part in _split(chunk[whose]):  # noqa: B023
                    answers.setdefault(c, []).append((mark[whose][part], check[whose][part], offset[part], runs[part], found[starts][part]))  # noqa: B023

            at = 0
            while at < len(order):
                to = max(at + 1, int(np.searchsorted(n_windows, (n_windows[at - 1] if at else 0) + SLAB, side="right")))
                to = int(np.searchsorted(group, group[to - 1], side="right"))  # whole groups of one suffix head
                rec = order[at:to]
                at = to
                if size[rec].sum() <= 4 * SLAB:
                    weigh(rec, np.zeros(len(rec), np.int64), size[rec])
                    continue
                for back in range(window - gram + 1):  # equal windows have their anchor at the same place
                    here = rec[(left[rec] >= back) & (left[rec] - back < size[rec])]
                    if len(here):
                        weigh(here, left[here] - back, left[here] - back + 1)
            for c, parts in answers.items():
                m, ch, o, k, f = (np.concatenate(x) for x in zip(*parts))
                cols = (m.astype("<u8").tobytes(), ch.astype("<u4").tobytes(), o.astype(np.uint8).tobytes(), k.astype(np.uint8).tobytes(), f.astype("<i8").tobytes())
                yield pa.record_batch([pa.array([c], pa.int32()), *(pa.array([x], pa.binary()) for x in cols)], names=["chunk", "mark", "check", "offset", "run", "found"])
            release()

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept_text", pa.string())] * with_text

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 5: remove what the answers say, and describe what is left."""
        release()
        whole = Chunk(left)
        removed = np.zeros(len(whole.buf), bool)
        if right.num_rows:
            get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in right.column(name).to_pylist()])
            mark, check, offset, run, found = get("mark", "<u8"), get("check", "<u4"), get("offset", np.uint8), get("run", np.uint8), get("found", "<i8")
            order = np.argsort(mark, kind="stable")
            mark = mark[order]
            check = check[order]
            offset = offset[order]
            run = run[order]
            found = found[order]
            del order
            release()
            for base, blocks, of in whole.pieces(window, gram):
                own, own_check = blocks.fingerprints()
                a, b = np.searchsorted(mark, own), np.searchsorted(mark, own, side="right")
                hit = np.flatnonzero(b > a)
                if not len(hit):
                    continue
                runs = b[hit] - a[hit]
                idx = np.repeat(a[hit] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                which = np.repeat(hit, runs)
                first = blocks.start[which] + offset[idx]
                ends = first + run[idx]
                smaller = (found[idx] < whole.ids[of[which]]) & (check[idx] == own_check[which])
                gone = np.zeros(len(blocks.buf) + 1, np.int16)  # at most one run starts or ends at a place, and under 200 overlap
                np.add.at(gone, first[smaller], 1)
                np.add.at(gone, ends[smaller] + window - 1, -1)
                removed[base : base + len(blocks.buf)] |= np.cumsum(gone, dtype=np.int16)[:-1] > 0
        rise = np.concatenate((np.flatnonzero(removed[:1]), np.flatnonzero(removed[1:] > removed[:-1]) + 1))
        starts, sizes = whole.offsets[:-1], np.diff(whole.offsets)
        inner = starts[(starts > 0) & (sizes > 0)]
        rise = np.union1d(rise, inner[removed[inner]])  # a document's first byte opens a run of its own
        n_spans = np.bincount(np.searchsorted(whole.offsets, rise, side="right") - 1, minlength=len(sizes))
        n_removed = np.zeros(len(sizes), np.int64)
        full = np.flatnonzero(sizes > 0)
        if len(full):
            n_removed[full] = np.add.reduceat(removed, starts[full], dtype=np.int64)
        at = whole.offsets - np.concatenate(([0], np.cumsum(n_removed)))
        digests, kept_texts = [], []
        for k in range(0, len(sizes), KEPT_ROWS):  # a text is there a few times at once, as array, bytes and string
            ends = at[k : k + KEPT_ROWS + 1] - at[k]
            part = slice(whole.offsets[k], whole.offsets[k + len(ends) - 1])
            kept = whole.buf[part][~removed[part]]
            texts = [kept[a:b].tobytes() for a, b in pairwise(ends.tolist())]
            digests += [hashlib.sha256(t).hexdigest() for t in texts]
            if with_text:
                kept_texts.append(pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()))
        del removed
        ids = pa.array(whole.ids, mask=whole.null_id)
        cols = [ids, pa.array(np.diff(whole.offsets)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(digests, pa.string())]
        if with_text:
            cols.append(pa.chunked_array(kept_texts, pa.string()))
        cols += [left.column(c).take(pa.array(whole.order)) for c in carry]
        release()
        return pa.Table.from_arrays(cols, names=[f[0] for f in fields] + list(carry))

    asked = chunks.mapInArrow(ask, "bucket int, chunk int, hashes binary, many binary")
    told = asked.repartitionById(n, F.col("bucket")).mapInArrow(shared, "chunk int, hashes binary, hot binary")
    sent = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, size binary, left binary, shift binary, least binary, most binary, mark binary, check binary, bytes binary")
    answered = sent.repartitionById(n, F.col("bucket")).mapInArrow(compare, "chunk int, mark binary, check binary, offset binary, run binary, found binary")
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields] + [docs.schema[c] for c in carry])
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(remove, schema)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated strings taken out of their texts.

    Other columns, whatever their names, stay as they are; a column ``n_chars`` is counted anew.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = remove_repeats(docs, with_text=True, carry=rest, **options)

    def column(c):
        kind = docs.schema[c].dataType
        if c in ("doc_id", "text"):
            return F.col("doc_id" if c == "doc_id" else "kept_text").cast(kind).alias(c)
        return F.char_length("kept_text").cast(kind).alias(c) if c == "n_chars" else F.col("carried").getField(c).alias(c)

    return kept.select(*map(column, docs.columns))
