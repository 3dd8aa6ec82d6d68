"""Many small lossless WebP pictures at once: the steps of ``webp`` over all pixels and codes of a batch.

Each picture is chosen, coded and read exactly as ``webp.encode`` and ``webp.decode`` would;
only the array operations are shared, so that short texts don't pay for hundreds of them each.
Pictures that want a transform or a palette, or that hold several groups of codes, go
through ``webp`` one by one.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from . import webp as W

WIDE = 280 + (1 << W.CACHES[0])
#: Widths of the five alphabets; that of green holds the cache where there is one.
ALPHABETS = np.array([WIDE, 256, 256, 256, 40])
ROW_AT = np.concatenate(([0], np.cumsum(ALPHABETS)))
#: Bits of the streams that are read together, about.
TOGETHER = 1 << 18


@lru_cache(1)
def _log_table() -> np.ndarray:
    n = np.arange(1 << 16, dtype=np.float64)
    return n * np.log2(np.maximum(n, 1))


def _n_log(counts: np.ndarray) -> np.ndarray:
    table = _log_table()
    return table[counts] if counts.size == 0 or counts.max() < len(table) else counts * np.log2(np.maximum(counts, 1))


def _sizes(counts: np.ndarray) -> np.ndarray:
    """``webp._sizes`` of rows of counts."""
    used = (counts > 0).sum(-1)
    return np.where(used > 1, _n_log(counts.sum(-1)) - _n_log(counts).sum(-1) + 5.0 * used, 0.0)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _stable_order(key: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of numbers of ``bits`` bits: they are sorted with their places, which is faster than by index."""
    low = max(1, len(key) - 1).bit_length()
    if bits + low > 64:
        return np.argsort(key, kind="stable")
    whole = key.astype(np.uint64) << np.uint64(low) | np.arange(len(key), dtype=np.uint64)
    whole.sort()
    return (whole & np.uint64((1 << low) - 1)).astype(np.int64)


def _same_before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs at an earlier place, and the last such place of each.

    Leading bits of the keys are sorted with the places; only where different keys agree in
    them, which hardly happens, the order is made from whole keys.
    """
    low = max(1, len(key) - 1).bit_length()
    mask = np.uint64((1 << low) - 1)
    whole = key & ~mask | np.arange(len(key), dtype=np.uint64)
    whole.sort()
    order = (whole & mask).astype(np.int64)
    same = np.flatnonzero(whole[1:] >> np.uint64(low) == whole[:-1] >> np.uint64(low))
    if (key[order[same + 1]] != key[order[same]]).any():
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order[same + 1], order[same]


def plain_ones(px: list[np.ndarray]) -> np.ndarray:
    """Which pictures are best without a transform and without a palette."""
    rows = np.array([len(p) for p in px])
    n = rows * W.ROW_PIXELS
    x8 = np.concatenate(px)  # all rows of all pictures
    first = np.cumsum(rows) - rows
    of = np.repeat(np.arange(len(px), dtype=np.int32), n)
    x = x8.reshape(-1, 3)
    signed = [np.ascontiguousarray(x.view(np.int8)[:, k]).astype(np.int32) for k in range(3)]

    def slopes(a: int, *others: int) -> list[np.ndarray]:
        d = signed[a] - np.repeat(np.bincount(of, signed[a], len(px)) / n, n)
        scale = np.bincount(of, d * d, len(px))
        found = [32 * np.bincount(of, d * signed[b], len(px)) / np.where(scale > 0, scale, 1) for b in others]
        return [np.repeat(np.where(scale > 0, np.clip(np.round(f), -128, 127), 0).astype(np.int32), n) for f in found]

    (by_green, blue_green), (blue_red,) = slopes(1, 0, 2), slopes(0, 2)
    cross = x.copy()
    cross[:, 0] -= (by_green * signed[1] >> 5).astype(np.uint8)
    cross[:, 2] -= ((blue_green * signed[1] >> 5) + (blue_red * signed[0] >> 5)).astype(np.uint8)
    green = x.copy()
    green[:, 0] -= x[:, 1]
    green[:, 2] -= x[:, 1]
    left, above = x8.copy(), x8.copy()
    left[:, 1:] -= x8[:, :-1]
    left[1:, 0] -= x8[:-1, 0]
    above[1:] -= x8[:-1]
    left[first, 0] = x8[first, 0]
    above[first, 0] = x8[first, 0]
    above[first, 1:] = x8[first, 1:] - x8[first, :-1]
    base = (of[:, None] * 3 + np.arange(3, dtype=np.int32)) << 8
    bits = np.empty((5, len(px)))
    for k, v in enumerate((x, cross, green, left.reshape(-1, 3), above.reshape(-1, 3))):
        bits[k] = _sizes(np.bincount((base | v).reshape(-1), minlength=len(px) * 768).reshape(-1, 256)).reshape(-1, 3).sum(1)
    bits[1:] += 60
    good = bits.argmin(0) == 0
    value = of.astype(np.int64) << 24 | x[:, 0].astype(np.int64) << 16 | x[:, 1].astype(np.int64) << 8 | x[:, 2]
    value.sort()
    new = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    times, doc = np.diff(np.append(new, len(value))), value[new] >> 24
    colours = np.bincount(doc, minlength=len(px))
    palette = np.where(colours > 1, _n_log(n) - np.bincount(doc, _n_log(times), len(px)) + 5.0 * colours, 0.0) + W.COLOUR_BITS * colours
    return good & ~((colours <= W.MOST_COLOURS) & (palette < bits[0]))


def copies(v: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``webp._copies`` of every picture: starts in the batch, lengths and distances."""
    none = np.zeros(0, np.int64)
    if len(v) < 4:
        return none, none, none
    wide = v.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (wide[2:] << np.uint64(31)))
    key += of[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    inside = np.flatnonzero(of[:-2] == of[2:])
    now, then = (inside[x] for x in _same_before(key[inside]))
    real = (v[now] == v[then]) & (v[now + 1] == v[then + 1]) & (v[now + 2] == v[then + 2]) & (of[now] == of[then])
    back = np.zeros(len(v), np.int64)
    back[now[real]] = (now - then)[real]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(back)) + 1))
    runs = np.diff(np.append(starts, len(back)))
    good = (back[starts] > 0) & (back[starts] < (1 << 20) - 120)
    out, at = [], 0
    for s, n, d in zip(starts[good].tolist(), runs[good].tolist(), back[starts[good]].tolist()):
        end = s + n + 2
        s = max(s, at)
        while end - s >= 3:
            size = min(end - s, 4096)
            out.append((s, size, d))
            s += size
            at = s
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """``webp.code_lengths`` of every row; rows with under two symbols have none."""
    rows, width = counts.shape
    out = np.zeros((rows, width), np.int64)
    n = (counts > 0).sum(1)
    busy = np.flatnonzero(n > 1)
    if not len(busy):
        return out
    n = n[busy]
    big = np.iinfo(np.int64).max // 4
    wide = int(n.max())
    weight = np.where(counts[busy] > 0, counts[busy] << 10 | np.arange(width), big)
    weight.sort(axis=1)
    order = weight[:, :wide] & 1023
    leaf = np.where(np.arange(wide) < n[:, None], weight[:, :wide] >> 10, big)
    leaf = np.concatenate([leaf, np.full((len(busy), 1), big)], 1)
    node = np.full((len(busy), wide + 1), big)
    above_leaf, above_node = np.zeros((len(busy), wide + 1), np.int32), np.zeros((len(busy), wide + 1), np.int32)
    i, j = np.zeros(len(busy), np.int64), np.zeros(len(busy), np.int64)
    turn = np.argsort(-n, kind="stable")  # rows with most symbols first, so that those still at work lead
    leaf, node, order, n, busy = leaf[turn], node[turn], order[turn], n[turn], busy[turn]
    for k in range(wide - 1):
        a = int(np.searchsorted(-n, -(k + 1), side="left"))  # rows with over k + 1 symbols
        r = np.arange(a)
        total = np.zeros(a, np.int64)
        for _ in range(2):
            x, y = leaf[r, i[:a]], node[r, j[:a]]
            take = x <= y
            total += np.where(take, x, y)
            t, f = np.flatnonzero(take), np.flatnonzero(~take)
            above_leaf[t, i[t]] = k
            above_node[f, j[f]] = k
            i[:a] += take
            j[:a] += ~take
        node[r, k] = total
    depth = np.zeros((len(busy), wide + 1), np.int64)
    for k in range(wide - 2, -1, -1):  # the last node of a row is its root, at depth zero
        a = int(np.searchsorted(-n, -(k + 2), side="left"))  # rows in which node k has one above
        depth[:a, k] = depth[np.arange(a), above_node[:a, k]] + 1
    sizes = np.take_along_axis(depth, above_leaf[:, :wide].astype(np.int64), 1) + 1
    there = np.arange(wide) < n[:, None]
    out[np.repeat(busy, n), order[there]] = sizes[there]
    for row in busy[(np.where(there, sizes, 0)).max(1) > most].tolist():
        out[row] = W.code_lengths(counts[row], most)
    return out


def canonical(lengths: np.ndarray, most: int) -> np.ndarray:
    """The codes of every row, lowest bit first."""
    codes = np.zeros_like(lengths)
    begin = np.zeros(len(lengths), np.int64)
    mirror = W._mirror(most)
    for n in range(1, most + 1):
        row, symbol = np.nonzero(lengths == n)
        if len(row):
            first = np.searchsorted(row, np.arange(len(lengths)))
            codes[row, symbol] = mirror[begin[row] + ((np.arange(len(row)) - first[row]) << (most - n))]
            begin += np.bincount(row, minlength=len(lengths)) << (most - n)
    return codes


def code_items(counts: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items a row, values, bits) that store the codes; ``lengths`` holds the alphabets of all rows one after another."""
    rows = len(counts)
    edge = np.concatenate(([True], (lengths[1:] != lengths[:-1]) | (row[1:] != row[:-1])))
    start = np.flatnonzero(edge)
    value, run, of = lengths[start], np.diff(np.append(start, len(lengths))), row[start]
    rest = np.where(value > 0, run - 1, run)
    span, least = np.where(value > 0, 6, 138), np.where(value > 0, 3, 11)
    full, tail = rest // span, rest % span
    # tokens of a run, in order: the length itself, full repeats, a shorter repeat, singles
    short = np.where(tail >= least, 1, np.where((value == 0) & (tail >= 3), 2, 0))
    singles = np.where(short > 0, 0, tail)
    times = np.stack([value > 0, full, short > 0, singles], 1).astype(np.int64)
    repeat = np.where(value > 0, 16, 18)
    symbol = np.stack([value, repeat, np.where(short == 2, 17, repeat), value], 1)
    extra = np.stack([np.zeros_like(value), span - least, np.where(short == 2, tail - 3, tail - least), np.zeros_like(value)], 1)
    more = np.stack([np.zeros_like(value), np.where(value > 0, 2, 7), np.where(value > 0, 2, np.where(short == 2, 3, 7)), np.zeros_like(value)], 1)
    flat = times.reshape(-1)
    symbol, extra, more = (np.repeat(x.reshape(-1), flat) for x in (symbol, extra, more))
    of = np.repeat(np.repeat(of, 4), flat)
    kinds = np.bincount(of * 19 + symbol, minlength=rows * 19).reshape(rows, 19)
    own = code_lengths(kinds, 7)
    one = np.flatnonzero((kinds > 0).sum(1) == 1)
    for r in one.tolist():  # a code of one symbol has no bits
        s = int(kinds[r].argmax())
        own[r, [s, 0 if s else 1]] = 1
    codes = canonical(own, 7)
    listed = own[:, W.LENGTH_ORDER]
    stored = np.maximum(4, 19 - (listed[:, ::-1] > 0).argmax(1))
    single = (counts > 0).sum(1) < 2
    head_value = np.concatenate([np.where(single, 5 | counts.argmax(1) << 3, (stored - 4) << 1)[:, None], listed, np.zeros((rows, 1), np.int64)], 1)
    head_bits = np.concatenate([np.where(single, 11, 5)[:, None], np.where(np.arange(19) < stored[:, None], 3, 0), np.ones((rows, 1), np.int64)], 1)
    head_bits[single, 1:] = 0
    head_value[single, 1:] = 0
    head_value[head_bits == 0] = 0
    n = np.where(single[of], 0, own[of, symbol] + more)
    v = np.where(single[of], 0, codes[of, symbol] | extra << own[of, symbol])
    tokens = np.bincount(of, minlength=rows)
    items = tokens + 21
    at = np.cumsum(items) - items
    value, bits = np.empty(items.sum(), np.int64), np.empty(items.sum(), np.int64)
    fixed = (at[:, None] + np.arange(21)).reshape(-1)
    value[fixed], bits[fixed] = head_value.reshape(-1), head_bits.reshape(-1)
    place = _spans(at + 21, tokens)
    value[place], bits[place] = v, n
    return items, value, bits


def encode_plain(px: list[np.ndarray]) -> list[bytes]:
    """Pictures of 64 columns without transform, as ``webp.encode`` stores them."""
    docs, bits_of_cache = len(px), W.CACHES[0]
    n = np.array([len(p) * p.shape[1] for p in px])
    of = np.repeat(np.arange(docs), n)
    begin = np.cumsum(n) - n
    x = np.concatenate([p.reshape(-1, 3) for p in px]).astype(np.int64)
    v = 255 << 24 | x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]
    start, size, back = copies(v, of)
    covered = np.zeros(len(v) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + size, -1)
    literal = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    near, near_code = W._near_order(W.ROW_PIXELS)
    at = np.minimum(np.searchsorted(near, back), len(near) - 1)
    l_sym, l_extra, l_more = W._prefixes(size)
    d_sym, d_extra, d_more = W._prefixes(np.where(near[at] == back, near_code[at], back + 120))
    slot = (v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - bits_of_cache)
    order = _stable_order(of << bits_of_cache | slot, docs.bit_length() + bits_of_cache)
    kept = np.zeros(len(v), bool)
    kept[order[1:]] = (v[order[1:]] == v[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    hit = kept[literal]

    def counted(at: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Symbols of the literals at ``at``, and ``more``."""
        base = of[at] * ROW_AT[-1]
        parts = [base + x[at, 1], *more, base + (ROW_AT[1] + x[at, 0]), base + (ROW_AT[2] + x[at, 2]), base + (ROW_AT[3] + 255)]
        return np.bincount(np.concatenate(parts), minlength=docs * ROW_AT[-1]).reshape(docs, -1)

    rows = lambda c: [c[:, a:b] for a, b in zip(ROW_AT[:-1], ROW_AT[1:])]
    base = of[start] * ROW_AT[-1]
    without = counted(literal, base + 256 + l_sym, base + ROW_AT[4] + d_sym)
    ent = literal[hit]
    entries = np.bincount(of[ent] * ROW_AT[-1] + 280 + slot[ent], minlength=docs * ROW_AT[-1]).reshape(docs, -1)
    with_ = without - counted(ent) + entries
    cached = sum(map(_sizes, rows(with_))) < sum(map(_sizes, rows(without)))
    hit &= cached[of[literal]]
    counts = np.where(cached[:, None], with_, without)
    padded = np.zeros((docs, 5, WIDE), np.int64)
    for k, c in enumerate(rows(counts)):
        padded[:, k, : c.shape[1]] = c
    padded = padded.reshape(-1, WIDE)
    found = code_lengths(padded, W.MOST_BITS).reshape(docs, 5, WIDE)
    lengths = np.concatenate([found[:, k, :n] for k, n in enumerate(ALPHABETS.tolist())], 1)
    codes = np.concatenate([canonical(c, W.MOST_BITS) for c in rows(lengths)], 1)
    # rows of all pictures: green is shorter where there is no cache
    wide = np.tile(ALPHABETS, (docs, 1))
    wide[~cached, 0] = 280
    flat = _spans((np.arange(docs)[:, None] * ROW_AT[-1] + ROW_AT[:-1]).reshape(-1), wide.reshape(-1))
    items, h_value, h_bits = code_items(padded, lengths.reshape(-1)[flat], np.repeat(np.arange(5 * docs), wide.reshape(-1)))
    items = items.reshape(docs, 5).sum(1)

    def look(doc: np.ndarray, row: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = ROW_AT[row] + symbol
        return codes[doc, k], lengths[doc, k]

    value, bits, here = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(v), bool)
    lit, ent = literal[~hit], literal[hit]
    doc = of[lit]
    (g, gn), (r, rn), (b, bn) = look(doc, 0, x[lit, 1]), look(doc, 1, x[lit, 0]), look(doc, 2, x[lit, 2])
    value[lit], bits[lit] = g | (r | b << rn) << gn, gn + rn + bn
    value[ent], bits[ent] = look(of[ent], 0, 280 + slot[ent])
    doc = of[start]
    (g, gn), (d, dn) = look(doc, 0, 256 + l_sym), look(doc, 4, d_sym)
    value[start] = g | (l_extra | (d | d_extra << dn) << l_more) << gn
    bits[start] = gn + l_more + dn + d_more
    here[literal] = here[start] = True
    place = np.flatnonzero(here)
    tokens = np.bincount(of[place], minlength=docs)

    total = 2 + items + tokens
    first = np.cumsum(total) - total
    all_value, all_bits = np.empty(total.sum(), np.int64), np.empty(total.sum(), np.int64)
    heights = np.array([len(p) for p in px])
    all_value[first] = W.SIGNATURE | W.ROW_PIXELS - 1 << 8 | heights - 1 << 22
    all_bits[first] = 40
    # no transform; the cache and its bits; one group
    all_value[first + 1] = np.where(cached, (1 | bits_of_cache << 1) << 1, 0)
    all_bits[first + 1] = np.where(cached, 7, 3)
    to = _spans(first + 2, items)
    all_value[to], all_bits[to] = h_value, h_bits
    to = _spans(first + 2 + items, tokens)
    all_value[to], all_bits[to] = value[place], bits[place]

    ends = np.cumsum(all_bits)
    size = ends[first + total - 1] - np.concatenate(([0], ends[first + total - 1][:-1]))
    base = np.cumsum(((size + 63) >> 6) + 1) - ((size + 63) >> 6) - 1
    at = ends - all_bits + np.repeat((base << 6) - (np.cumsum(size) - size), total)
    words = np.zeros(int(base[-1] + ((size[-1] + 63) >> 6)) + 2, "<u8")
    some = np.flatnonzero(all_bits > 0)
    val, at = all_value[some].astype(np.uint64), at[some]
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    over = np.where(shift > 0, val >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[new]] |= np.bitwise_or.reduceat(val << shift, new)
    words[word[new] + 1] |= np.bitwise_or.reduceat(over, new)
    raw = words.tobytes()
    out = []
    for a, n_bits in zip((8 * base).tolist(), size.tolist()):
        chunk = raw[a : a + (n_bits + 7 >> 3)]
        out.append(b"RIFF" + struct.pack("<I", 12 + len(chunk) + (len(chunk) & 1)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1))
    return out


def encode_many(px: list[np.ndarray]) -> list[bytes]:
    """``webp.encode`` of pictures of 64 columns."""
    if not px:
        return []
    plain = plain_ones(px)
    done = iter(encode_plain([p for p, ok in zip(px, plain) if ok]) if plain.any() else [])
    return [next(done) if ok else W.encode(p) for p, ok in zip(px, plain.tolist())]


def _tables(codes: list[W.Code], most: int) -> np.ndarray:
    """The tables of codes one after another, each for the next ``most`` bits."""
    out = np.empty((len(codes), 1 << most), np.int32)
    many = [k for k, c in enumerate(codes) if c.single is None]
    if many:
        out[many] = W.code_tables([codes[k].lengths for k in many], most)
    for k, c in enumerate(codes):
        if c.single is not None:
            out[k] = c.single << 8
    return out.reshape(-1)


def read_together(jobs: list[tuple]) -> list[np.ndarray]:
    """``webp._read_group`` of several (bits, codes, total, width, cache bits), whose streams are short."""
    streams = [b.data[b.at >> 3 :] + bytes(16) for b, *_ in jobs]
    n = 8 * np.array([len(s) for s in streams])
    of = np.repeat(np.arange(len(jobs), dtype=np.int32), n)
    joined = b"".join(streams)
    win = W._windows(joined, 0, len(joined) * 8).view(np.int32)
    first = np.cumsum(n) - n
    place = np.arange(len(win), dtype=np.int32)
    win = np.concatenate((win, np.zeros(128, np.int32)))
    # the tables of all pictures one after another, each as often as it fits in the same power of two
    most = max(1, *(c.most for _, codes, *_ in jobs for c in codes))
    tables = [_tables([codes[k] for _, codes, *_ in jobs], most) for k in range(5)]
    mask, base = np.int32((1 << most) - 1), of << np.int32(most)

    def at_all(k: int, at: np.ndarray | slice, base: np.ndarray) -> np.ndarray:
        return tables[k][win[at] & mask | base]

    green = at_all(0, slice(0, len(place)), base)
    end = place + (green & 255)
    goes = end.copy()
    for k in (1, 2, 3):
        if any(codes[k].single is None for _, codes, *_ in jobs):
            goes += at_all(k, goes, base) & 255
    other = np.flatnonzero(green >= 256 << 8)
    goes[other] = end[other]
    copy = other[green[other] < 280 << 8]
    if len(copy):
        more = W.EXTRA_BITS[(green[copy] >> 8) - 256]
        d = at_all(4, end[copy] + more, base[copy])
        goes[copy] = end[copy] + more + (d & 255) + W.EXTRA_BITS[np.minimum(d >> 8, 39)]
    step = memoryview(goes)
    chain, sizes = [], []
    keep = chain.append
    for k, (bits, _, total, _, _) in enumerate(jobs):
        # all places that could hold a symbol; what the last byte holds besides is cut off below
        p, stop, before = int(first[k]) + (bits.at & 7), int(first[k] + n[k]) - 128, len(chain)
        if jobs[k][1][0].single is not None and goes[p] == p:  # no symbol has any bits
            chain += [p] * total
        else:
            while p < stop:
                keep(p)
                p = step[p]
        sizes.append(len(chain) - before)
    token = np.array(chain)
    doc = np.repeat(np.arange(len(jobs)), sizes)
    sizes = np.array(sizes)
    g, q = (green[token] >> 8).astype(np.int64), end[token]
    channels = []
    at = base[token]
    for k in (1, 2, 3):
        if all(codes[k].single is not None for _, codes, *_ in jobs):  # as that of alpha is, it has no bits
            channels.append(np.repeat([codes[k].single for _, codes, *_ in jobs], sizes))
            continue
        e = at_all(k, q, at)
        channels.append((e >> 8).astype(np.int64))
        q = q + (e & 255)
    final = np.where(g < 256, q, end[token])
    colour = channels[2] << 24 | channels[0] << 16 | (g & 255) << 8 | channels[1]
    c = np.flatnonzero((g >= 256) & (g < 280))
    run, back = np.ones(len(g), np.int64), np.zeros(len(g), np.int64)
    if len(c):
        k, q = g[c] - 256, end[token[c]]
        more = W.EXTRA_BITS[k]
        run[c] = W.EXTRA_BASE[k] + (win[q] & ((1 << more) - 1))
        d = at_all(4, q + more, base[token[c]])
        q = q + more + (d & 255)
        far = W.EXTRA_BASE[d >> 8] + (win[q] & ((1 << W.EXTRA_BITS[d >> 8]) - 1))
        wide = np.array([w for *_, w, _ in jobs])
        short = np.stack([W._distances(w) for w in wide.tolist()])[doc[c], np.minimum(far, 120)]
        back[c] = np.where(far > 120, far - 120, short)
        final[c] = q + W.EXTRA_BITS[d >> 8]
    totals = np.array([t for _, _, t, _, _ in jobs])
    ends = np.cumsum(run)
    head = np.concatenate(([0], ends))[np.cumsum(sizes) - sizes]
    begin = ends - run - head[doc]  # in its own picture
    used = begin < totals[doc]
    g, colour, run, back, begin, doc, final = (x[used] for x in (g, colour, run, back, begin, doc, final))
    whole = np.bincount(doc, run, len(jobs)).astype(np.int64)
    late = np.flatnonzero(final > (first + n - 128)[doc])
    if len(late) or (whole < totals).any():
        raise ValueError("the picture ends early")
    if (whole > totals).any() or (back > begin).any():
        raise ValueError("a back-reference leaves the picture")
    value = np.repeat(colour, run)
    to = np.arange(len(value)) - np.repeat(back, run)
    entry = np.repeat(np.where(g >= 280, g - 280, -1), run)
    if (g >= 280).any():
        value, to = _from_caches(value, to, entry, np.repeat(doc, run), np.array([b for *_, b in jobs]))
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    return np.split(value[to[: totals.sum()]].astype(np.uint32), np.cumsum(totals)[:-1])


def _from_caches(value: np.ndarray, to: np.ndarray, entry: np.ndarray, of: np.ndarray, cache_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp._from_cache`` for pixels of several pictures."""
    root = to
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    slot = np.where(entry >= 0, entry, (value * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits[of]))[root]
    # pictures without a cache have no entries, so their slots don't matter
    key = of << 12 | slot & 4095
    order = _stable_order(key, len(cache_bits).bit_length() + 12)
    key, is_entry = key[order], entry[order] >= 0
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.maximum.accumulate(np.where(new | ~is_entry, np.arange(len(order)), 0))
    value, to = np.append(value, 0), np.append(to, len(value))
    to[order[is_entry]] = np.where(is_entry[last], len(to) - 1, order[last])[is_entry]
    return value, to


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """``webp.decode`` of several files: pixels (height, width, 4)."""
    opened = [W.opened(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    wait, held = [], 0

    def finish():
        for k, argb in zip(wait, read_together([opened[k].group for k in wait])):
            out[k] = opened[k].finished(argb)
        wait.clear()

    for k, picture in enumerate(opened):
        bits = picture.bits
        if picture.group is None or bits.end - bits.at > TOGETHER:
            out[k] = picture.finished(picture.pixels())
            continue
        wait.append(k)
        held += bits.end - bits.at + 128
        if held >= TOGETHER:
            finish()
            held = 0
    if wait:
        finish()
    return out
