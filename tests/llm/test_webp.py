"""The lossless decoder against pictures written with every feature, and exact round trips."""

import heapq
import random
import struct

import numpy as np
import pytest

from corpusloom.llm import webp as V
from corpusloom.llm import webp_batch


def code_lengths(counts):
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) == 1:
        return out, used[0]
    heap = [(counts[s], k, [s]) for k, s in enumerate(used)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    return out, None


class Coder:
    def __init__(self, counts, w):
        lengths, single = code_lengths(counts)
        self.codes = {}
        if single is not None:
            if single < 256:
                w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(single, 8)
                self.codes[single] = (0, 0)
                return
            other = 0
            lengths[single] = lengths[other] = 1
        w.put(0, 1)
        w.put(15, 4)
        for s in V.LENGTH_ORDER:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for n in lengths:
            w.put(int(f"{n:04b}"[::-1], 2), 4)
        code = 0
        for n in range(1, 16):
            code <<= 1
            for s, m in enumerate(lengths):
                if m == n:
                    self.codes[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                    code += 1

    def put(self, w, s):
        w.put(*self.codes[s])


def prefix(v):
    """Prefix symbol, extra bits and their number for a value from 1 on."""
    for s in range(40):
        n = 0 if s < 4 else (s - 2) >> 1
        base = s + 1 if s < 4 else ((2 + (s & 1)) << n) + 1
        if base <= v < base + (1 << n):
            return s, v - base, n


def put_image(w, px, width, top, rnd, cache_bits=0, meta_bits=0, copies=True):
    total, height = len(px), len(px) // width
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups, across = [0] * total, 1
    if top:
        w.put(1 if meta_bits else 0, 1)
        if meta_bits:
            w.put(meta_bits - 2, 3)
            across = -(-width >> meta_bits) if False else (width + (1 << meta_bits) - 1) >> meta_bits
            down = (height + (1 << meta_bits) - 1) >> meta_bits
            tiles = [rnd.randrange(2) for _ in range(across * down)]
            tiles[0], tiles[-1] = 0, 1
            put_image(w, [t << 8 for t in tiles], across, False, rnd)
            groups = [tiles[(k // width >> meta_bits) * across + (k % width >> meta_bits)] for k in range(total)]
    tokens, cache, at = [], {}, 0
    while at < total:
        found = None
        if copies:
            for back in (1, width, width + 1, 2 * width, 7):
                n = 0
                while back <= at and at + n < total and n < 200 and px[at + n] == px[at + n - back]:
                    n += 1
                if n >= 3:
                    found = (n, back)
                    break
        key = (px[at] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if found:
            tokens.append((groups[at], "copy", found))
            n = found[0]
        elif cache_bits and cache.get(key) == px[at]:
            tokens.append((groups[at], "cache", key))
            n = 1
        else:
            tokens.append((groups[at], "pixel", px[at]))
            n = 1
        for k in range(at, at + n):
            if cache_bits:
                cache[(px[k] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        at += n
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(V.NEIGHBOURS)))}
    n_groups = max(groups) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(n_groups)]

    def symbols(kind, v):
        if kind == "pixel":
            return [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + v, 0, 0)]
        s, e, n = prefix(v[0])
        d = prefix(near.get(v[1], v[1] + 120))
        return [(0, 256 + s, e, n), (4, *d)]

    for g, kind, v in tokens:
        for c, s, _, _ in symbols(kind, v):
            counts[g][c][s] += 1
    coders = []
    for g in range(n_groups):
        for c in counts[g]:
            if not any(c):
                c[0] = 1
        coders.append([Coder(c, w) for c in counts[g]])
    for g, kind, v in tokens:
        for c, s, e, n in symbols(kind, v):
            coders[g][c].put(w, s)
            w.put(e, n)


def argb_bytes(px):
    return [[v >> s & 255 for s in (24, 16, 8, 0)] for v in px]


def pack(p):
    return p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]


def forward_predict(px, width, modes, bits):
    """Residuals of the plain definition of the 14 predictors."""
    p = argb_bytes(px)
    across = (width + (1 << bits) - 1) >> bits
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda x: min(255, max(0, x))
    out = []
    for k, v in enumerate(p):
        y, x = divmod(k, width)
        if k == 0:
            q = [255, 0, 0, 0]
        elif y == 0:
            q = p[k - 1]
        elif x == 0:
            q = p[k - width]
        else:
            L, T, TL = p[k - 1], p[k - width], p[k - width - 1]
            TR = p[k - width + 1]
            m = modes[(y >> bits) * across + (x >> bits)]
            select = L if sum(abs(t - c) for t, c in zip(T, TL)) < sum(abs(s - c) for s, c in zip(L, TL)) else T
            half = [clamp(int(a + (a - c) / 2)) if (a - c) % 2 == 0 else clamp(a + int((a - c) / 2)) for a, c in zip(avg(L, T), TL)]
            q = [
                [255, 0, 0, 0], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR)),
                select, [clamp(a + b - c) for a, b, c in zip(L, T, TL)], half,
            ][m]
        out.append(pack([(a - b) % 256 for a, b in zip(v, q)]))
    return out


def forward_cross(px, width, tiles, bits):
    across = (width + (1 << bits) - 1) >> bits
    s8 = lambda v: v - 256 if v > 127 else v
    out = []
    for k, v in enumerate(px):
        y, x = divmod(k, width)
        _, red_to_blue, green_to_blue, green_to_red = argb_bytes([tiles[(y >> bits) * across + (x >> bits)]])[0]
        a, r, g, b = argb_bytes([v])[0]
        nb = b - (s8(green_to_blue) * s8(g) >> 5) - (s8(red_to_blue) * s8(r) >> 5)
        nr = r - (s8(green_to_red) * s8(g) >> 5)
        out.append(pack([a, nr % 256, g, nb % 256]))
    return out


def picture(px, width, transforms, rnd, **options):
    height = len(px) // width
    w = V.BitWriter()
    w.put(V.SIGNATURE, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    now, wide = list(px), width
    for t in transforms:
        w.put(1, 1)
        if t == "predict":
            bits = 2
            across, down = (wide + 3) >> 2, (height + 3) >> 2
            modes = [rnd.randrange(14) for _ in range(across * down)]
            w.put(0, 2), w.put(bits - 2, 3)
            put_image(w, [255 << 24 | m << 8 for m in modes], across, False, rnd)
            now = forward_predict(now, wide, modes, bits)
        elif t == "cross":
            bits = 3
            across, down = (wide + 7) >> 3, (height + 7) >> 3
            tiles = [255 << 24 | rnd.randrange(1 << 24) for _ in range(across * down)]
            w.put(1, 2), w.put(bits - 2, 3)
            put_image(w, tiles, across, False, rnd)
            now = forward_cross(now, wide, tiles, bits)
        elif t == "green":
            w.put(2, 2)
            now = [pack([a, (r - g) % 256, g, (b - g) % 256]) for a, r, g, b in argb_bytes(now)]
        else:
            colours = sorted(set(now))
            w.put(3, 2), w.put(len(colours) - 1, 8)
            deltas, last = [], [0, 0, 0, 0]
            for c in argb_bytes(colours):
                deltas.append(pack([(x - y) % 256 for x, y in zip(c, last)]))
                last = c
            put_image(w, deltas, len(colours), False, rnd)
            n = len(colours)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            each, per = 8 >> bits, 1 << bits
            rows = []
            for y in range(height):
                line = [colours.index(v) for v in now[y * wide : (y + 1) * wide]]
                for a in range(0, wide, per):
                    rows.append(255 << 24 | sum(v << each * k for k, v in enumerate(line[a : a + per])) << 8)
            now, wide = rows, (wide + per - 1) // per
    w.put(0, 1)
    put_image(w, now, wide, True, rnd, **options)
    raw = w.value.to_bytes((w.n + 7) // 8, "little")
    body = b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pixels(rnd, width, height, colours):
    palette = [rnd.randrange(1 << 32) for _ in range(colours)]
    out = []
    for k in range(width * height):
        out.append(out[k - width] if k >= width and rnd.random() < 0.5 else out[k - 1] if k and rnd.random() < 0.5 else rnd.choice(palette))
    return out


CASES = [
    ([], {}), ([], {"cache_bits": 4}), ([], {"meta_bits": 2}), ([], {"copies": False, "cache_bits": 1}), (["predict"], {}), (["cross"], {}), (["green"], {}), (["palette"], {}),
    (["predict", "cross", "green"], {"cache_bits": 6, "meta_bits": 3}), (["green", "predict"], {"meta_bits": 2}), (["palette", "predict"], {"cache_bits": 3}),
]


@pytest.mark.parametrize("colours", [1, 2, 3, 12, 60])
@pytest.mark.parametrize("transforms, options", CASES)
def test_decoder_reads_every_feature(transforms, options, colours):
    rnd = random.Random(colours)
    width, height = rnd.randrange(5, 40), rnd.randrange(5, 30)
    px = pixels(rnd, width, height, colours)
    got = V.decode(picture(px, width, transforms, rnd, **options))
    want = np.array(argb_bytes(px), np.uint8).reshape(height, width, 4)[:, :, [1, 2, 3, 0]]
    assert (got == want).all()


def test_neighbour_codes_are_complete():
    assert len(V.NEIGHBOURS) == 120 == len(set(V.NEIGHBOURS))


def test_encoder_chooses_what_helps():
    rnd = random.Random(3)
    y, x = np.mgrid[0:40, 0:64]
    ramp = np.stack([x * 3 + y, x + 2 * y, 5 * x], -1).astype(np.uint8)
    grey = np.repeat(np.array([[rnd.randrange(256) for _ in range(64)] for _ in range(40)], np.uint8)[..., None], 3, 2)
    half = grey.copy()
    half[..., 0] = grey[..., 1].astype(np.int8) // 2
    few = np.array([(200, 7, 9), (3, 80, 99)], np.uint8)[np.array([[rnd.randrange(2) for _ in range(64)] for _ in range(40)])]
    sixteen = np.array([(k * 37 % 256, k * 91 % 256, k * 7 % 256) for k in range(14)], np.uint8)[np.array([[rnd.randrange(14) for _ in range(61)] for _ in range(40)])]
    many = np.array([(k * 37 % 256, k * 91 % 256, k * 7 % 256) for k in range(600)], np.uint8)[np.minimum(599, np.array([[int(rnd.expovariate(0.02)) for _ in range(64)] for _ in range(40)]))]
    noise = np.array([[[rnd.randrange(256) for _ in range(3)] for _ in range(64)] for _ in range(40)], np.uint8)
    want = {"predictor": ramp, "green": grey, "cross-colour": half, "palette": few, "entries": many, "copies": np.tile(noise, (3, 1, 1)), "literals": noise}
    for feature, px in [*want.items(), ("palette", sixteen)]:
        seen = V.Counter()
        assert (V.decode(V.encode(px), seen)[:, :, :3] == px).all()
        assert seen[feature] > 0, (feature, seen)


def test_group_reading_agrees_with_reading_one_by_one(monkeypatch):
    rnd = random.Random(12)
    words = ["the", "quick", "brown", "Fuchs", "é", "日本"]
    for n in (1, 40, 400, 4000):
        px = np.frombuffer(V.payload_of(" ".join(rnd.choice(words) for _ in range(n)))[0], np.uint8).reshape(-1, 64, 3)
        media = V.encode(px)
        for bits in (1 << 19, 64, 200):
            monkeypatch.setattr(V, "PIECE_BITS", bits)
            assert (V.decode(media)[:, :, :3] == px).all()
        monkeypatch.undo()


def test_many_at_once_are_as_one_by_one(sf):
    import pyarrow.parquet as pq

    from corpusloom.llm import webp_batch as B

    rnd = random.Random(4)
    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:120]
    texts += ["", "a", "ab" * 300, "x" * 5000, "".join(map(chr, range(1, 300))), "\x00" * 500, "the cat " * 900, "".join(rnd.choice("ab") for _ in range(3000)), "é" * 40_000]
    px = [p for t in texts for p in V.planes_of(V.payload_of(t)[0])]
    ramp = np.add.outer(np.arange(30) * 2, np.arange(64) * 3)[..., None] + np.array([0, 7, 90])
    px += [ramp.astype(np.uint8), np.zeros((1, 64, 3), np.uint8), np.random.default_rng(1).integers(0, 256, (20, 64, 3)).astype(np.uint8)]
    one = [V.encode(p) for p in px]
    assert B.encode_many(px) == one
    order = rnd.sample(range(len(px)), len(px))
    assert B.encode_many([px[k] for k in order]) == [one[k] for k in order]  # neighbours don't matter
    for files in (one, one[::-1], one[:1]):
        for p, back in zip(px if files is not one[::-1] else px, B.decode_many(one)):
            assert (back[:, :, :3] == p).all()
    assert B.encode_many([]) == [] == B.decode_many([])
    assert sum(B.plain_ones(px)) > 100


def test_given_documents_use_the_format(sf):
    import pyarrow.parquet as pq

    seen, size, full = V.Counter(), 0, 0
    for text in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist():
        payload, _ = V.payload_of(text)
        media = V.store(payload)
        size, full = size + len(media), full + len(payload)
        px = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        if len(px) <= V.MOST_ROWS:
            assert (V.decode(media, seen)[:, :, :3] == px).all()
    assert size < 0.62 * full and min(seen[k] for k in ("copies", "entries", "literals", "unequal lengths")) > 0, (size / full, seen)


@pytest.mark.parametrize("text", [None, "", "a", "a" * 191, "a" * 192, "a" * 193, "é" * 2_000_000, "".join(map(chr, range(1, 300))), "\x00" * 500])
def test_payload_round_trip(text):
    payload, n = V.payload_of(text)
    assert len(payload) % 192 == 0 and payload and payload[:n] == (text or "").encode() and not payload[n:].strip(b" ")
    media = V.store(payload)
    assert np.concatenate(V.pictures(media))[:, :, :3].tobytes() == payload


def test_bad_files_are_refused():
    media = V.store(V.payload_of("abc def ghi " * 30)[0])
    for bad in (b"", media[:30], media[:-40], b"RIFX" + media[4:]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            V.decode(bad)


def test_media_query_against_plain_digests(spark):
    import hashlib
    import zlib

    texts = [None, "", "abc", "é" * 100, "line one\nline two " * 40, "z" * 191, "z" * 192]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in V.media_features(df, with_media=True).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        rows = len(full) // 192
        means = ",".join(f"{sum(full[c::3]) / (64 * rows):.3f}" for c in range(3))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(full[-16:]) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert r["feature"].startswith(f"64x{rows};rgb={means};ahash=")


def test_media_query(spark):
    rows = [(1, "abc"), (1, "abc"), (2, None), (3, "x" * 70_000), (None, "abc")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, feature string")
    got = V.media_features(df, with_media=True).collect()
    assert len(got) == 5 and len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got if r["n_bytes"] == 3}) == 1
    for r in got:
        back = np.concatenate(V.pictures(r["media"]))[:, :, :3].tobytes()
        assert r["payload_bytes"] == len(back) and r["media_bytes"] == len(r["media"])
    assert V.media_features(df.limit(0)).count() == 0


def test_orders_of_a_batch():
    """Sorting keys with their places gives the stable order, and copies are found where keys agree in their leading bits only."""
    rng = np.random.default_rng(5)
    for n, bits in ((1, 8), (2, 8), (5_000, 11), (70_000, 20), (300, 63)):
        key = rng.integers(0, 1 << bits, n)
        assert (webp_batch._stable_order(key, bits) == np.argsort(key, kind="stable")).all()
    alike = np.uint64(7 << 40) + rng.integers(0, 40, 4_000).astype(np.uint64)  # low bits that the places displace
    for key in (alike, rng.integers(0, 900, 4_000).astype(np.uint64) << np.uint64(50), np.zeros(0, np.uint64), np.zeros(1, np.uint64)):
        last, found = {}, {}
        for k, x in enumerate(key.tolist()):
            if x in last:
                found[k] = last[x]
            last[x] = k
        now, then = webp_batch._same_before(key)
        assert dict(zip(now.tolist(), then.tolist())) == found and len(now) == len(found)
