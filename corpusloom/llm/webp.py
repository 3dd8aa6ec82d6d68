"""Lossless WebP: a decoder of the whole format, an encoder, and media columns made with them.

``decode`` reads any lossless WebP picture: prefix codes (simple and normal, one
group or many), back-references with the neighbourhood distance codes, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.  A
picture with one group of codes, as most are, is read by array operations: the
symbol at every bit place is looked up at once, the places that hold one are
followed from the first, and copies and cache entries are resolved as pointers.

``encode`` stores rows of 64 pixels of three samples, so 192 bytes are a row.  It
chooses between no transform, cross-colour, subtract-green, two predictors and a
palette by the bits that each promises, copies stretches of three pixels and more
that were there before, tries colour caches, and gives every channel a prefix code
of least size.  A picture has at most 4,096 rows; longer payloads become several
pictures one after another.

Defined cases: null text is empty; an empty text is one row of blanks; texts of
any length are stored whole; equal texts give equal values; repeated rows are
repeated in the result; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of, map_batches, slices

ROW_PIXELS = 64
ROW_BYTES = 3 * ROW_PIXELS
#: Rows of a picture; longer payloads become several.
MOST_ROWS = 1 << 12
#: Longest code that the encoder gives a symbol, and the colour caches, in bits, that it tries.
MOST_BITS = 11
CACHES = (8,)
#: Colours of a palette that the encoder makes, so that it packs pixels; with more, copies and the cache do better.
MOST_COLOURS = 16
#: About the bits of a colour in a palette.
COLOUR_BITS = 32
#: Bits of a stream that are looked up at once.
PIECE_BITS = 1 << 19
SIGNATURE = 0x2F

# Fixed values of the format: the order in which lengths of code-length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

# Fixed values of the format: (columns back, rows back) of the 120 short distance codes.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads bits of a byte string, lowest bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def peek_far(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end:
            raise ValueError("the picture ends early")
        return value


@lru_cache(16)
def _mirror(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in reverse."""
    out = np.zeros(1 << n, np.int64)
    for k in range(n):
        out |= (np.arange(1 << n) >> k & 1) << (n - 1 - k)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols in the order of their codes, and the codes, lowest bit first."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths[used[-1]])
    width = 1 << (most - lengths[used])
    return used, _mirror(most)[np.cumsum(width) - width]


def code_tables(lengths: list[bytes | bytearray], most: int) -> np.ndarray:
    """A row for each code: the symbol above the length of its code, for the next ``most`` bits.

    No code is longer than ``most`` bits, and each has two symbols or more.
    """
    n = np.frombuffer(b"".join(lengths), np.uint8)
    sizes = np.array([len(x) for x in lengths])
    used = np.flatnonzero(n)
    row = np.repeat(np.arange(len(lengths)), sizes)[used]
    symbol, size = used - (np.cumsum(sizes) - sizes)[row], n[used].astype(np.int64)
    order = np.argsort(row << 4 | size, kind="stable")
    row, symbol, size = row[order], symbol[order], size[order]
    width = 1 << (most - size)
    if (np.bincount(row, width, len(lengths)) != 1 << most).any():
        raise ValueError("a prefix code isn't complete")
    return (symbol << 8 | size).astype(np.int32).repeat(width).reshape(len(lengths), -1)[:, _mirror(most)]


class Code:
    """A canonical prefix code, from the code lengths of its symbols."""

    def __init__(self, lengths: bytes | bytearray):
        self.lengths = lengths
        used = len(lengths) - lengths.count(0)
        self.most = max(lengths) if used > 1 else 0
        #: The symbol of a code that has only one and so no bits.
        self.single = None if used > 1 else lengths.index(max(lengths))

    @cached_property
    def table(self) -> np.ndarray:
        """The symbol above the length of its code, for the next ``most`` bits."""
        return code_tables([self.lengths], self.most)[0] if self.most else np.array([self.single << 8], np.int32)

    @cached_property
    def listed(self) -> list[int]:
        return self.table.tolist()

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        found = self.listed[bits.peek(self.most)]
        bits.at += found & 255
        return found >> 8

    def look(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and code lengths at the start of each window of bits."""
        found = self.table[windows & ((1 << self.most) - 1)]
        return found >> 8, found & 255


@lru_cache(4096)
def _length_table(lengths: bytes) -> tuple[list[int], int]:
    """As ``Code.listed`` for a code of code lengths, which has few symbols, and the bits that index it."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] << 8 if used else 0], 0
    most = used[-1][0]
    table, mirror, at = [0] * (1 << most), _mirror(most).tolist(), 0
    for n, s in used:
        if at < 1 << most:
            table[mirror[at] :: 1 << n] = [s << 8 | n] * (1 << (most - n))
        at += 1 << (most - n)
    if at != 1 << most:
        raise ValueError("a prefix code isn't complete")
    return table, most


def _read_code(bits: Bits, size: int) -> Code:
    lengths = bytearray(size)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = bytearray(19)
    stored = 4 + bits.read(4)
    ahead = bits.peek_far(3 * stored)
    bits.at += 3 * stored
    for k in range(stored):
        of_lengths[LENGTH_ORDER[k]] = ahead >> 3 * k & 7
    table, most = _length_table(bytes(of_lengths))
    mask = (1 << most) - 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    place, have, ahead = bits.at, 0, 0  # ``ahead`` holds the next ``have`` bits
    while at < size and left:
        left -= 1
        if have < 16:
            ahead, have = int.from_bytes(bits.data[place >> 3 : (place >> 3) + 16], "little") >> (place & 7), 120
        s = table[ahead & mask]
        n = s & 255
        s >>= 8
        ahead >>= n
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            more = 2 if s == 16 else 3 if s == 17 else 7
            times = (ahead & ((1 << more) - 1)) + (11 if s == 18 else 3)
            ahead >>= more
            n += more
            if s == 16:
                lengths[at : at + times] = bytes([last]) * times
            at += times
        place += n
        have -= n
    bits.at = place
    if at > size:
        raise ValueError("code lengths run over")
    if place > bits.end:
        raise ValueError("the picture ends early")
    return Code(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    """The value that a length or distance prefix and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_pixels(bits: Bits, width: int, height: int, top: bool, seen: Counter | None = None) -> np.ndarray:
    """An entropy-coded picture as ARGB numbers, row by row."""
    groups, groups_of, group_bits, cache_bits = _read_groups(bits, width, height, top)
    if len(groups) == 1:
        return _read_group(bits, groups[0], width * height, width, cache_bits, seen)
    return _read_mixed(bits, width, height, groups, groups_of, group_bits, cache_bits)


def _read_groups(bits: Bits, width: int, height: int, top: bool) -> tuple[list[list[Code]], list[int] | None, int, int]:
    """Groups of codes, the group of each tile, the tiles' size in bits, and the cache's bits."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache")
    groups_of, group_bits, n_groups = None, 0, 1
    if top and bits.read(1):
        group_bits = bits.read(3) + 2
        meta = _read_pixels(bits, _blocks(width, group_bits), _blocks(height, group_bits), False)
        groups_of = (meta >> 8 & 0xFFFF).tolist()
        n_groups = max(groups_of) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[_read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(n_groups)]
    return groups, groups_of, group_bits, cache_bits


def _read_mixed(bits: Bits, width: int, height: int, groups: list[list[Code]], groups_of: list[int], group_bits: int, cache_bits: int) -> np.ndarray:
    """The pixels of a picture with several groups of codes, one by one, as a pixel's place names its group."""
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    at = kept = 0
    across = _blocks(width, group_bits)
    while at < total:
        y, x = divmod(at, width)
        group = groups[groups_of[(y >> group_bits) * across + (x >> group_bits)]]
        g = group[0].read(bits)
        if g < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = a << 24 | r << 16 | g << 8 | b
            at += 1
        elif g < 280:
            length = _extra(bits, g - 256)
            code = _extra(bits, group[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                x, y = NEIGHBOURS[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the picture")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            while kept < at:
                cache[(out[kept] * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[at] = cache[g - 280]
            at += 1
        if bits.at > bits.end:
            raise ValueError("the picture ends early")
    return np.array(out, np.uint32)


def _windows(data: bytes, bit: int, n: int) -> np.ndarray:
    """The 25 bits or more from each of ``n`` bit places on; ``bit`` is a multiple of eight."""
    part = data[bit >> 3 : (bit + n + 7 >> 3) + 4]
    part += bytes(((n + 7) >> 3) + 4 - len(part))
    four = np.ndarray(((n + 7) >> 3,), "<u4", part, strides=(1,))
    return (four[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)[:n]


EXTRA_BITS = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
EXTRA_BASE = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])


@lru_cache(8)
def _distances(width: int) -> np.ndarray:
    """How far back each of the short distance codes goes in a picture of a width; code 0 isn't used."""
    return np.array([1, *(max(1, x + y * width) for x, y in NEIGHBOURS)])


def _read_group(bits: Bits, codes: list[Code], total: int, width: int, cache_bits: int, seen: Counter | None = None) -> np.ndarray:
    """The pixels of a picture with one group of codes.

    For every bit place of a piece the end of the symbol that would begin there is
    looked up at once; following these from the first symbol on gives the symbols
    that are there.  Literals are then placed, and copies and cache entries are
    pointers that are followed to a literal, by doubling.
    """
    green, red, blue, alpha, dist = codes
    found: list[tuple[np.ndarray, ...]] = []
    left = total
    if all(c.single is not None for c in codes[:4]):
        g, r, b, a = (c.single for c in codes[:4])
        if g < 256:
            return np.full(total, a << 24 | r << 16 | g << 8 | b, np.uint32)
    while left > 0:
        first = bits.at & ~7
        n = min(PIECE_BITS, bits.end - first)
        if n <= 0:
            raise ValueError("the picture ends early")
        win = _windows(bits.data, first, n + 128)
        g, size = green.look(win[:n])
        at = np.arange(n, dtype=np.int32) + size
        goes = at.copy()
        for code in (red, blue, alpha):
            if code.single is None:
                goes = goes + (code.table[win[goes] & ((1 << code.most) - 1)] & 255)
        if cache_bits:
            goes = np.where(g < 280, goes, at)
        copy = np.flatnonzero((g >= 256) & (g < 280))
        count = None
        if len(copy):
            k = g[copy] - 256
            more = EXTRA_BITS[k]
            count = np.ones(n, np.int32)
            count[copy] = EXTRA_BASE[k] + (win[at[copy]] & ((1 << more) - 1))
            d, size = dist.look(win[at[copy] + more])
            goes[copy] = at[copy] + more + size + EXTRA_BITS[d]
        step, pixels = memoryview(goes), memoryview(count) if count is not None else None
        place, p = [], bits.at - first
        if pixels is None:
            for _ in range(left):
                if p >= n:
                    break
                place.append(p)
                p = step[p]
            left -= len(place)
        else:
            while left > 0 and p < n:
                place.append(p)
                left -= pixels[p]
                p = step[p]
        if not place:
            raise ValueError("the picture ends early")
        bits.at = first + p
        if left < 0:
            raise ValueError("a back-reference leaves the picture")
        if bits.at > bits.end:
            raise ValueError("the picture ends early")
        place = np.array(place)
        g, q = g[place].astype(np.int64), at[place].astype(np.int64)
        r, size = red.look(win[q])
        q1 = q + size
        b, size = blue.look(win[q1])
        a, _ = alpha.look(win[q1 + size])
        colour = (a.astype(np.int64) << 24) | (r.astype(np.int64) << 16) | ((g & 255) << 8) | b
        k = np.where((g >= 256) & (g < 280), g - 256, 0)
        run = np.where((g >= 256) & (g < 280), EXTRA_BASE[k] + (win[q] & ((1 << EXTRA_BITS[k]) - 1)), 1)
        back = np.zeros(len(g), np.int64)
        c = np.flatnonzero((g >= 256) & (g < 280))
        if len(c):
            q = q[c] + EXTRA_BITS[k[c]]
            d, size = dist.look(win[q])
            q = q + size
            far = EXTRA_BASE[d] + (win[q] & ((1 << EXTRA_BITS[d]) - 1))
            back[c] = np.where(far > 120, far - 120, _distances(width)[np.minimum(far, 120)])
        found.append((g, colour, run, back))
    g, colour, run, back = (np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]
    if seen is not None:
        seen.update(literals=int((g < 256).sum()), copies=int(((g >= 256) & (g < 280)).sum()), entries=int((g >= 280).sum()))
        seen["unequal lengths"] += any(len(np.unique(c.table & 255)) > 1 for c in codes[:3] if c.single is None)
    if len(g) == total and not cache_bits and not back.any():
        return colour.astype(np.uint32)
    begin = np.cumsum(run) - run
    if (back > begin).any():
        raise ValueError("a back-reference leaves the picture")
    value = np.repeat(colour, run)
    to = np.arange(total) - np.repeat(back, run)
    if cache_bits:
        value, to = _from_cache(value, to, np.repeat(np.where(g >= 280, g - 280, -1), run), cache_bits)
    while True:
        further = to[to]
        if (further == to).all():
            return value[to[:total]].astype(np.uint32)
        to = further


def _from_cache(value: np.ndarray, to: np.ndarray, entry: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers with those of cache entries: to the last pixel before that isn't one and has the entry's place."""
    root = to
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    slot = np.where(entry >= 0, entry, (value * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits))[root]
    order = np.argsort(slot, kind="stable")
    sorted_slot, is_entry = slot[order], entry[order] >= 0
    new = np.ones(len(order), bool)
    new[1:] = sorted_slot[1:] != sorted_slot[:-1]
    # an entry that nothing has filled holds zero, which one pixel more stands for
    last = np.maximum.accumulate(np.where(new | ~is_entry, np.arange(len(order)), 0))
    source = order[last]
    empty = is_entry[last]
    value, to = np.append(value, 0), np.append(to, len(value))
    to[order[is_entry]] = np.where(empty, len(to) - 1, source)[is_entry]
    return value, to


def _bytes(argb: np.ndarray, width: int) -> np.ndarray:
    """Rows of pixels of (blue, green, red, alpha)."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(-1, width, 4)


def _predict(argb: np.ndarray, width: int, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height = len(argb) // width
    kinds = np.unique(modes >> 8 & 15)
    if len(kinds) == 1 and kinds[0] in (1, 2):  # sums along rows or columns
        px = _bytes(argb, width).reshape(height, width, 4).copy()
        px[0, 0, 3] += 255
        lead = px[:, 0] if kinds[0] == 1 else px[0]
        lead[:] = np.cumsum(lead, axis=0, dtype=np.uint8)
        return np.cumsum(px, axis=2 - int(kinds[0]), dtype=np.uint8).reshape(-1).view("<u4").astype(np.uint32)
    px = _bytes(argb, width).astype(np.int64).reshape(height, width, 4).tolist()
    across = _blocks(width, size_bits)
    mode_of = (modes >> 8 & 15).tolist()
    avg = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    for y in range(height):
        row, up = px[y], px[y - 1] if y else None
        for x in range(width):
            if y == 0:
                p = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                p = up[0]
            else:
                left, above, corner = row[x - 1], up[x], up[x - 1]
                right = up[x + 1] if x + 1 < width else row[0]
                mode = mode_of[(y >> size_bits) * across + (x >> size_bits)]
                if mode == 1:
                    p = left
                elif mode == 2:
                    p = above
                elif mode == 3:
                    p = right
                elif mode == 4:
                    p = corner
                elif mode == 5:
                    p = avg(avg(left, right), above)
                elif mode == 6:
                    p = avg(left, corner)
                elif mode == 7:
                    p = avg(left, above)
                elif mode == 8:
                    p = avg(corner, above)
                elif mode == 9:
                    p = avg(above, right)
                elif mode == 10:
                    p = avg(avg(left, corner), avg(above, right))
                elif mode == 11:
                    to_left = sum(abs(t - c) for t, c in zip(above, corner))
                    to_above = sum(abs(s - c) for s, c in zip(left, corner))
                    p = left if to_left < to_above else above
                elif mode == 12:
                    p = [clip(s + t - c) for s, t, c in zip(left, above, corner)]
                elif mode == 13:
                    p = []
                    for a, c in zip(avg(left, above), corner):
                        d = a - c
                        p.append(clip(a + (d // 2 if d >= 0 else -(-d // 2))))
                else:
                    p = [0, 0, 0, 255]
            row[x] = [(v + q) & 255 for v, q in zip(row[x], p)]
    return np.array(px, np.uint8).reshape(-1).view("<u4").astype(np.uint32)


def _cross_colour(argb: np.ndarray, width: int, elements: np.ndarray, size_bits: int) -> np.ndarray:
    height = len(argb) // width
    px = _bytes(argb, width).astype(np.int32).reshape(height, width, 4)
    tiles = _bytes(elements, _blocks(width, size_bits)).view(np.int8).astype(np.int32)
    y, x = np.arange(height) >> size_bits, np.arange(width) >> size_bits
    to_red, to_blue, red_to_blue = (tiles[y][:, x, k] for k in (0, 1, 2))
    signed = lambda v: (v & 255 ^ 128) - 128
    green = signed(px[..., 1])
    red = px[..., 2] + (to_red * green >> 5) & 255
    px[..., 0] = px[..., 0] + (to_blue * green >> 5) + (red_to_blue * signed(red) >> 5) & 255
    px[..., 2] = red
    return px.astype(np.uint8).reshape(-1).view("<u4").astype(np.uint32)


def _add_green(argb: np.ndarray) -> np.ndarray:
    px = _bytes(argb, 1).reshape(-1, 4).copy()
    px[:, 0] += px[:, 1]
    px[:, 2] += px[:, 1]
    return px.reshape(-1).view("<u4").astype(np.uint32)


def _palette(argb: np.ndarray, width: int, packed: int, table: np.ndarray, pack_bits: int) -> np.ndarray:
    index = argb >> 8 & 255
    if pack_bits:
        each = 8 >> pack_bits
        rows = index.reshape(-1, packed)
        spread = rows[:, :, None] >> (np.arange(1 << pack_bits) * each).astype(np.uint32) & ((1 << each) - 1)
        index = spread.reshape(len(rows), -1)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


@dataclass
class Picture:
    """A file whose head is read: what to undo, and the codes before the pixels."""

    bits: Bits
    width: int
    height: int
    has_alpha: int
    undo: list[tuple]
    coded_width: int
    groups: tuple

    @property
    def group(self) -> tuple | None:
        """(bits, codes, pixels, width, cache bits) if one group of codes holds all pixels."""
        if len(self.groups[0]) > 1:
            return None
        return self.bits, self.groups[0][0], self.coded_width * self.height, self.coded_width, self.groups[3]

    def pixels(self, seen: Counter | None = None) -> np.ndarray:
        return _read_group(*self.group, seen) if self.group else _read_mixed(self.bits, self.coded_width, self.height, *self.groups)

    def finished(self, argb: np.ndarray) -> np.ndarray:
        """Red, green, blue and alpha (height, width, 4), with the transforms undone."""
        for kind, wide, *rest in reversed(self.undo):
            if kind == 0:
                argb = _predict(argb, wide, *rest)
            elif kind == 1:
                argb = _cross_colour(argb, wide, *rest)
            elif kind == 2:
                argb = _add_green(argb)
            else:
                argb = _palette(argb, wide, _blocks(wide, rest[1]), *rest)
        out = _bytes(argb, self.width)[:, :, [2, 1, 0, 3]]
        if not self.has_alpha:
            out[:, :, 3] = 255
        return out


def opened(data: bytes) -> Picture:
    """Read a file up to its pixels."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless picture")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k[0] == kind for k in undo):
            raise ValueError("a transform occurs twice")
        if kind in (0, 1):
            size_bits = bits.read(3) + 2
            tiles = _read_pixels(bits, _blocks(now, size_bits), _blocks(height, size_bits), False)
            undo.append((kind, now, tiles, size_bits))
        elif kind == 2:
            undo.append((kind, now))
        else:
            n = bits.read(8) + 1
            deltas = _read_pixels(bits, n, 1, False)
            table = np.cumsum(_bytes(deltas, n)[0], axis=0, dtype=np.uint8).reshape(-1).view("<u4").astype(np.uint32)
            pack_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, table, pack_bits))
            now = _blocks(now, pack_bits)
    return Picture(bits, width, height, has_alpha, undo, now, _read_groups(bits, now, height, True))


def decode(data: bytes, seen: Counter | None = None) -> np.ndarray:
    """Pixels (height, width, 4) of red, green, blue and alpha of one lossless WebP file.

    ``seen`` counts the transforms, copies, cache entries and literals of the picture.
    """
    picture = opened(data)
    if seen is not None:
        seen.update(("predictor", "cross-colour", "green", "palette")[k[0]] for k in picture.undo)
    return picture.finished(picture.pixels(seen))


class BitWriter:
    """Collects bits, lowest first."""

    def __init__(self):
        self.value, self.n, self.end = 0, 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of a prefix code of least total size; if a code would be longer than ``most`` bits, of flattened counts."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        return out
    weight = counts[used]
    while True:
        order = np.argsort(weight, kind="stable")
        w = weight[order].tolist()
        n, i = len(w), 0
        j = n
        above = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if i < n and (j == k or w[i] <= w[j]):
                    total += w[i]
                    above[i] = k
                    i += 1
                else:
                    total += w[j]
                    above[j] = k
                    j += 1
            w.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= most:
            out[used[order]] = depth[:n]
            return out
        weight = (weight + 1) // 2


def _put_single(w: BitWriter, symbol: int) -> None:
    w.put(5 | symbol << 3, 11)


def _put_code(w: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Store the code of counted symbols; returns the codes (lowest bit first) and their lengths."""
    lengths = code_lengths(counts)
    codes = np.zeros(len(counts), np.int64)
    if not lengths.any():
        _put_single(w, int(np.argmax(counts)))
        return codes, lengths
    used, code = canonical(lengths)
    codes[used] = code
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits and their number
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for value, run in zip(lengths[edges[:-1]].tolist(), np.diff(edges).tolist()):
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= (3 if value else 11):
            n = min(6 if value else 138, run)
            tokens.append((16, n - 3, 2) if value else (18, n - 11, 7))
            run -= n
        if not value and run >= 3:
            tokens.append((17, run - 3, 3))
            run = 0
        tokens += [(value, 0, 0)] * run
    lengths_of = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    if not lengths_of.any():  # a code of one symbol has no bits
        lengths_of[[tokens[0][0], 0 if tokens[0][0] else 1]] = 1
    used, code = canonical(lengths_of)
    code_of = dict(zip(used.tolist(), code.tolist()))
    sizes = lengths_of.tolist()
    stored = max(4, 1 + max(k for k, x in enumerate(LENGTH_ORDER) if sizes[x]))
    w.put((stored - 4) << 1, 5)
    for x in LENGTH_ORDER[:stored]:
        w.put(sizes[x], 3)
    w.put(0, 1)
    value = n = 0
    for t, extra, more in tokens:
        value |= (code_of[t] | extra << sizes[t]) << n
        n += sizes[t] + more
    w.put(value, n)
    return codes, lengths


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths or distances."""
    symbol = np.searchsorted(EXTRA_BASE, values, side="right") - 1
    return symbol, values - EXTRA_BASE[symbol], EXTRA_BITS[symbol]


def _copies(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the stretches that are copied from before, greedily from the left.

    A stretch begins where the last equal run of three pixels is as far back as for
    all its pixels, so it is found as a run of equal distances.
    """
    none = np.zeros(0, np.int64)
    if len(v) < 4:
        return none, none, none
    wide = v.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (wide[2:] << np.uint64(31)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return none, none, none
    now, then = order[same + 1], order[same]
    real = (v[now] == v[then]) & (v[now + 1] == v[then + 1]) & (v[now + 2] == v[then + 2])
    back = np.zeros(len(key) + 1, np.int64)
    back[now[real]] = (now - then)[real]
    edge = np.flatnonzero(np.diff(back)) + 1
    starts = np.concatenate(([0], edge))
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


def _sizes(counts: np.ndarray) -> np.ndarray:
    """About the bits of the symbols of each row under its best code, with the code itself."""
    n = counts.astype(np.float64)
    whole = n.sum(1)
    bits = whole * np.log2(np.maximum(whole, 1)) - (n * np.log2(np.maximum(n, 1))).sum(1)
    used = (counts > 0).sum(1)
    return np.where(used > 1, bits + 5.0 * used, 0.0)


def _put_pixels(w: BitWriter, v: np.ndarray, width: int, top: bool) -> bytes:
    """Pixels as copies, cache entries and literals, whichever cache is best; returns the stream after the codes."""
    start, size, back = _copies(v)
    literal = np.zeros(len(v) + 1, np.int64)
    np.add.at(literal, start, 1)
    np.add.at(literal, start + size, -1)
    literal = np.flatnonzero(np.cumsum(literal[:-1]) == 0)
    channels = lambda k: (v[k] >> 8 & 255, v[k] >> 16 & 255, v[k] & 255, v[k] >> 24)
    near, near_code = _near_order(width)
    at = np.minimum(np.searchsorted(near, back), len(near) - 1)
    far = np.where(near[at] == back, near_code[at], back + 120)
    l_sym, l_extra, l_more = _prefixes(size)
    d_sym, d_extra, d_more = _prefixes(far)

    def counted(key: np.ndarray | None, hit: np.ndarray, cache_bits: int):
        g, r, b, a = channels(literal[~hit])
        wide = 280 + (1 << cache_bits if cache_bits else 0)
        parts = [g, 256 + l_sym, wide + r, 2 * wide + b, 3 * wide + a, 4 * wide + d_sym]
        if cache_bits:
            parts.append(280 + key[literal[hit]])
        return np.bincount(np.concatenate(parts), minlength=5 * wide).reshape(5, wide)

    none = np.zeros(len(literal), bool)
    best = (counted(None, none, 0), none, None, 0)
    cost = _sizes(best[0]).sum()
    for cache_bits in CACHES if top else ():
        key = (v.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits)
        order = np.argsort(key.astype(np.int16), kind="stable")
        kept = np.zeros(len(v), bool)
        kept[order[1:]] = v[order[1:]] == v[order[:-1]]
        hit = kept[literal]
        counts = counted(key, hit, cache_bits)
        here = _sizes(counts).sum()
        if here < cost:
            cost, best = here, (counts, hit, key, cache_bits)
    counts, hit, key, cache_bits = best
    w.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if top:
        w.put(0, 1)
    (gc, gl), (rc, rl), (bc, bl), (ac, al), (dc, dl) = (_put_code(w, c[:n]) for c, n in zip(counts, (counts.shape[1], 256, 256, 256, 40)))
    plain = literal[~hit]
    g, r, b, a = channels(plain)
    joined = (bc[b] | ac[a] << bl[b], bl[b] + al[a])
    joined = (rc[r] | joined[0] << rl[r], rl[r] + joined[1])
    words = [(gc[g] | joined[0] << gl[g], gl[g] + joined[1])]
    places = [plain]
    if cache_bits:
        e = 280 + key[literal[hit]]
        words.append((gc[e], gl[e]))
        places.append(literal[hit])
    if len(start):
        n = dl[d_sym]
        tail, n_tail = dc[d_sym] | d_extra << n, n + d_more
        tail, n_tail = l_extra | tail << l_more, l_more + n_tail
        words.append((gc[256 + l_sym] | tail << gl[256 + l_sym], gl[256 + l_sym] + n_tail))
        places.append(start)
    order = np.argsort(np.concatenate(places), kind="stable") if len(places) > 1 else slice(None)
    value = np.concatenate([x for x, _ in words])[order].astype(np.uint64)
    return _packed(w, value, np.concatenate([n for _, n in words])[order])


def _packed(w: BitWriter, value: np.ndarray, n: np.ndarray) -> bytes:
    """What ``w`` holds and then values of ``n`` bits each, at most 63, as bytes."""
    head = w.n + 63 >> 6
    end = w.n + np.cumsum(n)
    w.end = int(end[-1]) if len(end) else w.n
    at = end - n
    words = np.zeros((int(end[-1] if len(end) else w.n) >> 6) + 2, "<u8")
    words[:head] = np.frombuffer(w.value.to_bytes(8 * head, "little"), "<u8")
    some = np.flatnonzero(n > 0)
    if len(some):
        value, at = value[some], at[some]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        over = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    return words.tobytes()[: int(end[-1] if len(end) else w.n) + 7 >> 3]


@lru_cache(8)
def _near_order(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances that have a short code, ascending, and the least code of each."""
    found = np.unique(_distances(width)[1:], return_index=True)
    return found[0], found[1] + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def _slope(x: np.ndarray, y: np.ndarray) -> int:
    """The multiplier, in 32nds, by which ``x`` says most about ``y``."""
    d = x - x.mean()
    scale = float((d * d).sum())
    return int(np.clip(round(32 * float((d * y).sum()) / scale), -128, 127)) if scale else 0


def _whitened(px: np.ndarray) -> list[tuple[int, tuple, np.ndarray]]:
    """(kind, parameters, pixels) under each transform but the palette: none, cross-colour, green, left, above."""
    x = px.astype(np.int32)
    r, g, b = (x[..., k] for k in range(3))
    sg, sr, sb = _signed(g), _signed(r), _signed(b)
    by_green, blue_green, blue_red = _slope(sg, sr), _slope(sg, sb), _slope(sr, sb)
    cross = np.stack([r - (by_green * sg >> 5), g, b - (blue_green * sg >> 5) - (blue_red * sr >> 5)], -1)
    left, above = x.copy(), x.copy()
    left[:, 1:] -= x[:, :-1]
    left[1:, 0] -= x[:-1, 0]
    above[1:] -= x[:-1]
    above[0, 1:] -= x[0, :-1]
    return [
        (-1, (), px), (1, (by_green, blue_green, blue_red), (cross & 255).astype(np.uint8)), (2, (), np.stack([r - g, g, b - g], -1).astype(np.uint8)),
        (0, (1,), (left & 255).astype(np.uint8)), (0, (2,), (above & 255).astype(np.uint8)),
    ]


def _argb(px: np.ndarray, alpha: int = 255) -> np.ndarray:
    x = px.reshape(-1, 3).astype(np.int64)
    return alpha << 24 | x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]


def _spread_sizes(variants: list[np.ndarray]) -> np.ndarray:
    """About the bits of each variant's pixels as literals."""
    flat = np.stack([x.reshape(-1, 3) for x in variants]).astype(np.int32)
    flat += 256 * np.arange(3 * len(variants), dtype=np.int32).reshape(-1, 1, 3)
    return _sizes(np.bincount(flat.reshape(-1), minlength=768 * len(variants)).reshape(-1, 256)).reshape(-1, 3).sum(1)


def _put_tile(w: BitWriter, value: int) -> None:
    """A picture of any size in which every pixel is ``value``: five codes of one symbol, and no bits."""
    w.put(0, 1)
    for x in (value >> 8 & 255, value >> 16 & 255, value & 255, value >> 24, 0):
        _put_single(w, x)


def encode(pixels: np.ndarray) -> bytes:
    """A lossless WebP file of pixels (height, width, 3), under the transform that promises the fewest bits."""
    height, width, _ = pixels.shape
    w = BitWriter()
    w.put(SIGNATURE | width - 1 << 8 | height - 1 << 22, 40)  # no alpha, version zero
    variants = _whitened(pixels)
    bits = _spread_sizes([x for _, _, x in variants]) + [60 * (k >= 0) for k, _, _ in variants]
    kind, given, px = variants[int(bits.argmin())]
    v, wide = _argb(px), width
    table, index = np.unique(v, return_inverse=True) if kind < 0 else (v, None)
    palette = len(table) <= MOST_COLOURS and kind < 0 and _sizes(np.bincount(index)[None])[0] + COLOUR_BITS * len(table) < bits.min()
    if palette:
        w.put(1 | 3 << 1 | len(table) - 1 << 3, 11)
        steps = np.diff(table.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
        raw = _put_pixels(w, np.ascontiguousarray(steps, np.uint8).reshape(-1).view("<u4").astype(np.int64), len(table), False)
        w = _resumed(raw, w)
        pack_bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        index, wide = index.reshape(height, width), _blocks(width, pack_bits)
        if pack_bits:
            each = 1 << pack_bits
            index = np.pad(index, ((0, 0), (0, wide * each - width))).reshape(height, wide, each)
            index = (index << (np.arange(each) * (8 >> pack_bits))).sum(2)
        v = 255 << 24 | index.reshape(-1).astype(np.int64) << 8
    elif kind >= 0:
        w.put(1 | kind << 1, 3)
        if kind == 0:
            w.put(7, 3)
            _put_tile(w, 255 << 24 | given[0] << 8)
            v = _argb(px, 0)
        elif kind == 1:
            w.put(7, 3)
            to_red, to_blue, red_to_blue = (x & 255 for x in given)
            _put_tile(w, 255 << 24 | red_to_blue << 16 | to_blue << 8 | to_red)
    w.put(0, 1)
    chunk = _put_pixels(w, v, wide, True)
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _resumed(raw: bytes, before: BitWriter) -> BitWriter:
    """A writer that goes on after the bits of ``raw``; the number of bits is what ``before`` was told."""
    w = BitWriter()
    w.value, w.n = int.from_bytes(raw, "little"), before.end
    return w


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text with blanks up to a positive multiple of 192 bytes, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES), len(raw)


def planes_of(payload: bytes) -> list[np.ndarray]:
    """The pictures (rows, 64, 3) of a payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
    return [rows[at : at + MOST_ROWS] for at in range(0, len(rows), MOST_ROWS)]


def store(payload: bytes) -> bytes:
    """The payload as lossless WebP pictures, one after another."""
    return b"".join(map(encode, planes_of(payload)))


def files_of(media: bytes) -> list[bytes]:
    """Stored media as files."""
    out, at = [], 0
    while at < len(media):
        to = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:to])
        at = to
    return out


def pictures(media: bytes) -> list[np.ndarray]:
    """The pictures of stored media, decoded."""
    return [decode(f) for f in files_of(media)]


def feature(planes: np.ndarray) -> str:
    """Size, channel means, and the 8 by 8 average hash of a stack of rows (rows, 64, 3)."""
    rows = len(planes)
    sums = planes.sum(axis=(0, 1), dtype=np.int64)
    grey = planes.sum(axis=2, dtype=np.int64).reshape(rows, 8, -1).sum(2)
    edge = np.minimum(np.arange(8) * rows // 8, rows - 1)
    parts = np.add.reduceat(grey, edge, axis=0) if rows >= 8 else grey[edge]
    count = np.diff(np.append(edge, rows)) if rows >= 8 else np.ones(8, np.int64)
    level = parts // count[:, None]
    bits = (level * level.size > level.sum()).reshape(-1)
    digest = np.packbits(bits).tobytes().hex()
    means = ",".join(f"{s / (rows * ROW_PIXELS):.3f}" for s in sums.tolist())
    return f"{ROW_PIXELS}x{rows};rgb={means};ahash={digest}"


def media_features(docs: DataFrame, *, with_media: bool = False) -> DataFrame:
    """Store every text as pictures, read them back, and describe what was read.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_pictures [, media])
    """

    from . import webp_batch

    def make():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text", 1 << 20):
                rows: list[tuple] = []
                payloads = [payload_of(text) for text in part.column("text").to_pylist()]
                cuts = [planes_of(p) for p, _ in payloads]
                files = iter(webp_batch.encode_many([x for c in cuts for x in c]))
                stored = [b"".join(next(files) for _ in c) for c in cuts]
                again = iter(webp_batch.decode_many([f for media in stored for f in files_of(media)]))
                for (_, n), media, c in zip(payloads, stored, cuts):
                    read = [next(again) for _ in c]
                    planes = (np.concatenate(read) if len(read) > 1 else read[0])[:, :, :3]
                    back = planes.tobytes()
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(planes), len(read))
                    rows.append(row + (media,) * with_media)
                cols = [pa.array(c) for c in zip(*rows)]
                for k in (0, 1, 3, 4):
                    cols[k] = cols[k].cast(pa.int64())
                cols[7] = cols[7].cast(pa.int32())
                yield pa.record_batch([part.column(0), *cols], names=["doc_id", *names])

        return step

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pictures"] + ["media"] * with_media
    kinds = ["long", "long", "string", "long", "long", "string", "string", "int"] + ["binary"] * with_media
    return map_batches(documents_of(docs), make, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
