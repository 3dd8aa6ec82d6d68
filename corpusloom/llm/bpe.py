"""Byte-level BPE by speculation and verification.

Texts are cut into words by array operations that follow the usual byte-level
pattern.  For each new word a greedy longest match in the vocabulary proposes
tokens; a vectorised check then tests every adjacent pair of tokens for whether
the merges, applied in rank order, would leave that seam open.  A sequence whose
tokens are stable and whose seams all hold is the exact encoding.  Only words
that fail are merged exactly.  Finished words are kept in a bounded cache that
compares whole word bytes, so a collision can't give a wrong id.

Defined cases: null text is empty text, which has no tokens; special tokens'
strings in a text become their ids, as the library's defaults have it; texts and
words of any length are encoded whole and by the same steps; equal texts and
repeated rows have equal results; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of, flat_bytes, map_batches, slices

NONE = np.int64(1) << 40
LONG_WORD = 48
#: Bytes of the pieces in which longer words are matched side by side, and by which neighbours overlap.
PIECE = 512
OVERLAP = 256
CACHE_BITS = 19
STORE_MOST = 4_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """By code point: 0 letter, 1 number, 2 other, 3 white space."""
    first = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    out = np.full(len(first), 2, np.uint8)
    out[first == "L"] = 0
    out[first == "N"] = 1
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = 3
    return out


def word_starts(cps: np.ndarray, opens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin.  ``opens`` marks where a segment begins; words stay in their segment."""
    n = len(cps)
    start = opens.copy()
    start[0] = True
    start[1:] |= classes[1:] != classes[:-1]
    run = np.flatnonzero(start)
    end = np.append(run[1:], n)
    kind = classes[run]
    follows = np.append(~opens[run[1:]], False)  # whether text of the same segment follows the run
    white = np.flatnonzero((kind == 3) & follows)
    last = end[white] - 1
    start[last] = True
    blank = cps[last] == 0x20
    start[end[white[blank]]] = False
    # contractions: a lone apostrophe where a word begins, and letters behind it
    quote = np.flatnonzero((kind == 2) & (end - run == 1) & (cps[run] == 0x27) & follows)
    if len(quote):
        at = run[quote]
        at = at[start[at] & (classes[at + 1] == 0)]
        two = at[np.isin(cps[at + 1], [ord(c) for c in "stmd"])]
        rest = at[at + 2 < n]
        rest = rest[~opens[rest + 2]]
        pairs = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}
        three = np.array([i for i in rest.tolist() if (int(cps[i + 1]), int(cps[i + 2])) in pairs], np.int64)
        for found, width in ((two, 2), (three, 3)):
            start[found + 1] = False
            after = found + width
            after = after[after < n]
            start[after[classes[after] == 0]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """A byte-level vocabulary and its merges, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = {k.encode(): v for k, v in added.items()}
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        size = max([*ids.values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in ids.items():
            self.token_bytes[i] = bytes(of_letter[c] for c in text)
        for text, i in added.items():
            self.token_bytes[i] = text.encode()
        self.byte_id = np.array([ids[c] for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_made = key[order], rank[order], made[order]
        #: For each token the rank of the merge that makes it (-1: a single byte), and its two parts.
        self.born = np.full(size, -1, np.int64)
        self.part_l = np.zeros(size, np.int64)
        self.part_r = np.zeros(size, np.int64)
        for arr, val in ((self.born, rank), (self.part_l, left), (self.part_r, right)):
            arr[made[::-1]] = val[::-1]
        self._trie(ids)
        lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.bytes_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        flat, counts = self.merge_exact(self.bytes_flat, self.byte_offsets[:-1], lengths)
        self.stable = counts == 1
        self.stable[counts == 1] &= flat[np.concatenate(([0], np.cumsum(counts)))[:-1][counts == 1]] == np.flatnonzero(counts == 1)

    def _trie(self, ids: dict[str, int]) -> None:
        edges: dict[int, int] = {}
        token = {0: -1}
        for i in ids.values():
            node = 0
            for b in self.token_bytes[i]:
                key = node << 8 | b
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token)
                    token[nxt] = -1
                node = nxt
            token[node] = i
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_key = keys[order]
        self.edge_to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.node_token = np.fromiter((token[i] for i in range(len(token))), np.int64, len(token))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where no merge has the pair) and places in the merge arrays."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE), at

    def longest(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of every word: flat tokens and tokens per word."""
        cur, ends = starts.copy(), starts + lengths
        act = np.flatnonzero(lengths > 0)
        counts = np.zeros(len(starts), np.int64)
        rounds = []
        while len(act):
            node = np.zeros(len(act), np.int64)
            p = cur[act]
            best = np.full(len(act), -1, np.int64)
            best_p = p.copy()
            live = np.arange(len(act))
            while len(live):
                key = node[live] << 8 | buf[p[live]]
                at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
                hit = self.edge_key[at] == key
                live = live[hit]
                node[live] = self.edge_to[at[hit]]
                p[live] += 1
                tok = self.node_token[node[live]]
                has = tok >= 0
                best[live[has]] = tok[has]
                best_p[live[has]] = p[live[has]]
                live = live[p[live] < ends[act[live]]]
            rounds.append((act, best))
            counts[act] += 1
            cur[act] = best_p
            act = act[best_p < ends[act]]
        offsets = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(offsets[-1], np.int64)
        for r, (words, tok) in enumerate(rounds):
            flat[offsets[words] + r] = tok
        return flat, counts

    def propose(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of words of any length, and which words have none.

        A long word's pieces are matched side by side, each a little into the next,
        and joined where both matches begin a token; a word whose pieces never agree
        has no proposal.
        """
        long_ = np.flatnonzero(lengths > PIECE + OVERLAP)
        flat, counts = self.longest(buf, starts, np.where(lengths > PIECE + OVERLAP, 0, lengths))
        fails = np.zeros(len(starts), bool)
        if not len(long_):
            return flat, counts, fails
        n_pieces = -(-(lengths[long_] - OVERLAP) // PIECE)
        word = np.repeat(long_, n_pieces)
        begin = PIECE * (np.arange(len(word)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
        last = np.zeros(len(word), bool)
        last[np.cumsum(n_pieces) - 1] = True
        size = np.where(last, lengths[word] - begin, PIECE + OVERLAP)
        tokens, n = self.longest(buf, starts[word] + begin, size)
        widths = np.diff(self.byte_offsets)[tokens]
        piece_at = np.cumsum(n) - n
        place = np.cumsum(widths) - widths
        place += np.repeat(begin - place[piece_at], n)
        joined: dict[int, np.ndarray] = {}
        k = 0
        for w, pieces in zip(long_.tolist(), n_pieces.tolist()):
            at, parts = 0, []
            for j in range(k, k + pieces):
                own = slice(piece_at[j], piece_at[j] + n[j])
                ends = None
                if j + 1 < k + pieces:
                    both = np.intersect1d(place[own], place[piece_at[j + 1] : piece_at[j + 1] + n[j + 1]], assume_unique=True)
                    if not len(both):
                        fails[w], parts = True, []
                        break
                    ends = both[0]
                parts.append(tokens[own][np.searchsorted(place[own], at) : None if ends is None else np.searchsorted(place[own], ends)])
                at = ends
            joined[w] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            k += pieces
        total = counts.copy()
        total[long_] = [len(joined[w]) for w in long_.tolist()]
        offsets = np.concatenate(([0], np.cumsum(total)))
        out = np.empty(offsets[-1], np.int64)
        out[np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts) + np.arange(len(flat))] = flat
        for w, x in joined.items():
            out[offsets[w] : offsets[w] + len(x)] = x
        return out, total, fails

    def seams_hold(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging in rank order keeps tokens ``x`` and ``y`` apart where they meet.

        The two tokens are taken apart again, later merge first, along the seam.
        A pair at the seam that has a merge of its own, of a rank before either
        side's next merge, would have been merged.
        """
        ok = np.ones(len(x), bool)
        x, y = x.copy(), y.copy()
        used_x, used_y = np.full(len(x), NONE), np.full(len(x), NONE)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            rank, _ = self._pairs(a, b)
            bad = (rank < NONE) & (rank < used_x[live]) & (rank <= used_y[live])
            ok[live[bad]] = False
            go = ~bad & ((self.born[a] >= 0) | (self.born[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            by_x = self.born[a] > self.born[b]
            lx, ly = live[by_x], live[~by_x]
            used_x[lx] = self.born[a[by_x]]
            x[lx] = self.part_r[a[by_x]]
            used_y[ly] = self.born[b[~by_x]]
            y[ly] = self.part_l[b[~by_x]]
        return ok

    def _merge_long(self, word: bytes) -> list[int]:
        """Exact merges of one long word, with a heap over a linked list."""
        sym = [int(self.byte_id[b]) for b in word]
        n = len(sym)
        nxt, prev, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        rank, at = self._pairs(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
        table: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a: int, b: int):
            found = table.get((a, b))
            if found is None:
                r, i = self._pairs(np.array([a]), np.array([b]))
                found = table[a, b] = (int(r[0]), int(self.pair_made[i[0]]))
            return found

        heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(rank) if r < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = look(a, b)[1]
            gone[j] = True
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                r = look(sym[i], sym[nxt[i]])[0]
                if r < NONE:
                    heapq.heappush(heap, (r, i, sym[i], sym[nxt[i]]))
            if prev[i] >= 0:
                h = prev[i]
                r = look(sym[h], sym[i])[0]
                if r < NONE:
                    heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return [s for s, g in zip(sym, gone) if not g]

    def merge_exact(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest rank first, leftmost first, until no pair has a merge."""
        m = len(starts)
        out: list[np.ndarray | None] = [None] * m
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[i] = np.array(self._merge_long(buf[starts[i] : starts[i] + lengths[i]].tobytes()), np.int64)
        word = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
        size = lengths[word]
        sym = self.byte_id[buf[np.repeat(starts[word] - np.cumsum(size) + size, size) + np.arange(size.sum())]]
        of = np.repeat(word, size)
        while len(sym):
            rank = np.full(len(sym), NONE)
            same = np.flatnonzero(of[1:] == of[:-1])
            found, at = self._pairs(sym[same], sym[same + 1])
            rank[same] = found
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sizes = np.diff(np.append(first, len(of)))
            least = np.minimum.reduceat(rank, first)
            done = least >= NONE
            if done.any():
                for a, n in zip(first[done].tolist(), sizes[done].tolist()):
                    out[of[a]] = sym[a : a + n]
                keep = np.repeat(~done, sizes)
                sym, of, rank = sym[keep], of[keep], rank[keep]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(least, sizes))
            pick = pick[np.concatenate(([True], of[pick[1:]] != of[pick[:-1]]))]
            _, at = self._pairs(sym[pick], sym[pick + 1])
            sym[pick] = self.pair_made[at]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, of = sym[keep], of[keep]
        counts = np.array([0 if o is None else len(o) for o in out], np.int64)
        filled = [o for o in out if o is not None]
        return (np.concatenate(filled) if filled else np.zeros(0, np.int64)), counts

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact tokens of words: speculate, verify, and merge those that fail."""
        flat, counts, fails = self.propose(buf, starts, lengths)
        of = np.repeat(np.arange(len(starts)), counts)
        fails[of[~self.stable[flat]]] = True
        seam = np.flatnonzero(of[1:] == of[:-1])
        seam = seam[~fails[of[seam]]]
        fails[of[seam[~self.seams_hold(flat[seam], flat[seam + 1])]]] = True
        if not fails.any():
            return flat, counts
        redo = np.flatnonzero(fails)
        again, n = self.merge_exact(buf, starts[redo], lengths[redo])
        new = counts.copy()
        new[redo] = n
        offsets = np.concatenate(([0], np.cumsum(new)))
        out = np.empty(offsets[-1], np.int64)
        fits = ~fails[of]
        within = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        out[(offsets[:-1][of] + within)[fits]] = flat[fits]
        out[np.repeat(offsets[:-1][redo] - np.cumsum(n) + n, n) + np.arange(n.sum())] = again
        return out, new


class Encoder:
    """Encodes slices of texts with a bounded cache of finished words.

    With ``special=False`` the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        self.vocab = vocabulary(path)
        self.special = self.vocab.special if special else {}
        self.classes = char_classes()
        self._clear()

    def _clear(self) -> None:
        slots = 1 << CACHE_BITS
        self.lo, self.hi = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.len = np.zeros(slots, np.int8)
        self.off, self.cnt = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.store, self.filled = np.zeros(1 << 16, np.int32), 0
        self.longer: dict[bytes, tuple[int, int]] = {}

    def _keep(self, tokens: np.ndarray) -> int:
        at = self.filled
        while at + len(tokens) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[at : at + len(tokens)] = tokens
        self.filled += len(tokens)
        return at

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """Byte places where segments begin, and the special tokens: start -> (end, id)."""
        opens = [offsets[:-1][offsets[1:] > offsets[:-1]]]
        special: dict[int, tuple[int, int]] = {}
        raw = data.tobytes()
        hits: list[tuple[int, int, int]] = []
        for text, i in self.special.items():
            at = raw.find(text)
            while at >= 0:
                hits.append((at, -len(text), i))
                at = raw.find(text, at + 1)
        hits.sort()  # the leftmost counts, and of those the longest
        ends = offsets[np.searchsorted(offsets, [h[0] for h in hits], side="right")].tolist() if hits else []
        free = 0
        for (at, minus, i), end in zip(hits, ends):
            if at >= free and at - minus <= end:
                free = at - minus
                special[at] = (free, i)
        if special:
            opens.append(np.array([*special, *(e for e, _ in special.values() if e < len(data))], np.int64))
        return np.unique(np.concatenate(opens)), special

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and id offsets by text, of texts given as flat UTF-8 bytes."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.filled > STORE_MOST or len(self.longer) > 200_000:
            self._clear()
        opens_b, special = self._segments(data, offsets)
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        opens = np.zeros(len(cps), bool)
        opens[np.searchsorted(begins, opens_b)] = True
        kinds = self.classes[cps]
        if special:
            edges = np.zeros(len(cps) + 1, np.int32)
            edges[np.searchsorted(begins, list(special))] += 1
            edges[np.searchsorted(begins, [b for b, _ in special.values()])] -= 1
            kinds[np.cumsum(edges[:-1]) > 0] = 4
        starts = begins[word_starts(cps, opens, kinds)]
        lengths = np.diff(np.append(starts, len(data)))
        off, cnt = self._look_up(data, starts, lengths)
        if special:
            at = np.searchsorted(starts, list(special))
            off[at] = self._keep(np.array([token for _, token in special.values()])) + np.arange(len(at))
            cnt[at] = 1
        idx = np.repeat(off - np.cumsum(cnt) + cnt, cnt) + np.arange(cnt.sum())
        total = np.concatenate(([0], np.cumsum(cnt)))
        return self.store[idx], total[np.searchsorted(starts, offsets)]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buf = np.concatenate((data, np.zeros(16, np.uint8)))
        eights = np.ndarray((len(data) + 8,), "<u8", buf.data, strides=(1,))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)

        def load(at, n):
            shift = np.uint64(8) * (np.uint64(8) - np.clip(n, 1, 8).astype(np.uint64))
            return np.where(n > 0, eights[at] & (full >> shift), np.uint64(0))

        off, cnt = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lengths <= 16)
        s, n = starts[short], lengths[short]
        lo, hi = load(s, n), load(np.minimum(s + 8, len(data)), n - 8)
        mixed = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (n.astype(np.uint64) << np.uint64(57))
        slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        hit = (self.lo[slot] == lo) & (self.hi[slot] == hi) & (self.len[slot] == n)
        off[short[hit]], cnt[short[hit]] = self.off[slot[hit]], self.cnt[slot[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            order = miss[np.lexsort((n[miss], hi[miss], lo[miss]))]
            a, b, c = lo[order], hi[order], n[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
            first = order[new]
            tokens, counts = self.vocab.encode_words(buf, s[first], n[first])
            at = self._keep(tokens) + np.cumsum(counts) - counts
            group = np.cumsum(new) - 1
            off[short[order]], cnt[short[order]] = at[group], counts[group]
            k = slot[first]
            self.lo[k], self.hi[k], self.len[k], self.off[k], self.cnt[k] = lo[first], hi[first], n[first], at, counts
        long_ = np.flatnonzero(lengths > 16)
        if len(long_):
            words = [buf[a : a + m].tobytes() for a, m in zip(starts[long_].tolist(), lengths[long_].tolist())]
            fresh = {w: i for w, i in zip(words, long_.tolist()) if w not in self.longer}
            if fresh:
                i = np.fromiter(fresh.values(), np.int64, len(fresh))
                tokens, counts = self.vocab.encode_words(buf, starts[i], lengths[i])
                at = self._keep(tokens) + np.cumsum(counts) - counts
                self.longer.update(zip(fresh, zip(at.tolist(), counts.tolist())))
            got = np.array([self.longer[w] for w in words], np.int64)
            off[long_], cnt[long_] = got[:, 0], got[:, 1]
        return off, cnt


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def decode_bytes(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that ids stand for, concatenated."""
    a, n = vocab.byte_offsets[ids], np.diff(vocab.byte_offsets)[ids]
    return vocab.bytes_flat[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids; bytes that aren't UTF-8 become replacement characters."""
    return decode_bytes(vocab, ids).tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every whole text."""

    def make():
        encoder = Encoder(path)

        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                ids, offsets = encoder(*flat_bytes(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([part.column(0), lists], names=["doc_id", "ids"])

        return step

    return map_batches(documents_of(docs), make, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the text decoded from them."""

    def make():
        encoder = Encoder(path)
        vocab = encoder.vocab

        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                ids, offsets = encoder(*flat_bytes(part.column("text")))
                raw = ids.astype("<u4").tobytes()
                back = decode_bytes(vocab, ids)
                sizes = np.concatenate(([0], np.cumsum(np.diff(vocab.byte_offsets)[ids])))[offsets]
                sha, again = [], []
                for k in range(part.num_rows):
                    sha.append(hashlib.sha256(raw[4 * offsets[k] : 4 * offsets[k + 1]]).hexdigest())
                    text = back[sizes[k] : sizes[k + 1]].tobytes().decode("utf-8", "replace")
                    again.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(sha), pa.array(again)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

        return step

    return map_batches(documents_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
