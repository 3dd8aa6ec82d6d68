"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts become flat arrays of symbols, one for each character.  A round finds in every
word the least rank of its adjacent pairs and merges the leftmost such pairs of all
words at once; then merged symbols are compacted, and words in which no pair is left
go.  Where a word holds the least rank more than once, all of these merge in one round
as long as no merge makes a pair that would come before the next of them, so the result is
that of one merge at a time.

Words end before each space that follows another character, and between two characters
that stand side by side in no piece, so no merge crosses them.  Finished words are kept in
the bounded cache of ``bpe.Encoder``, which compares whole word bytes.

Defined cases: null text is empty text, which has no tokens; a text's words are those of
the text with one space before it; U+2581 stands for a space, as the library has it;
characters without a piece become their bytes; the names of control and byte pieces in a
text are ordinary characters; texts and words of any length are encoded whole; equal texts
and repeated rows have equal results; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import NONE, STORE_MOST, Encoder
from .common import documents_of, flat_bytes, map_batches, slices

SPACE = "▁"
#: Kinds of pieces, as model files number them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
CODE_POINTS = 0x110000


def model_of(path: str):
    """The parsed model file; only merges over unchanged text with byte fallback are read here."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if model.trainer_spec.model_type != 2 or not plain or not model.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only merge models with identity normalisation, a space in front and byte fallback are read")
    return model


class Pieces:
    """The pieces of a model and the pairs that merge into them, as arrays."""

    def __init__(self, path: str):
        model = model_of(path)
        size = len(model.pieces)
        self.token_bytes: list[bytes] = [b""] * size
        self.byte_token = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                normal[p.piece] = i
                self.token_bytes[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == BYTE:
                byte = int(p.piece[3:5], 16)
                self.byte_token[byte] = i
                self.token_bytes[i] = bytes([byte])
        #: Symbols: the pieces, then characters that only longer pieces hold, then one for all other characters.
        alone = sorted({c for text in normal for c in text} - set(normal))
        symbol = normal | {c: size + k for k, c in enumerate(alone)}
        self.size, self.other = size, size + len(alone)
        self.of_char = np.full(CODE_POINTS, self.other, np.int64)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.of_char[0x20] = self.of_char[ord(SPACE)]
        scores = {i: model.pieces[i].score for i in normal.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs: list[tuple[int, int, int, int]] = []
        beside: set[tuple[int, int]] = set()
        for text, i in normal.items():
            beside.update((symbol.get(a, self.other), symbol.get(b, self.other)) for a, b in zip(text, text[1:]))
            for k in range(1, len(text)):
                a, b = symbol.get(text[:k]), symbol.get(text[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, order[scores[i]], i))
        self.pair_key, self.pair_rank, self.pair_made = self._sorted(pairs)
        self.beside = np.unique(np.array([a << 20 | b for a, b in beside], np.int64))
        blank = int(self.of_char[0x20])
        #: Whether a space after another character always begins a word.
        self.spaces_open = not any(b == blank != a for a, b in beside)
        lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.bytes_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    @staticmethod
    def _sorted(pairs: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, rank, made = np.array(pairs, np.int64).T
        key = a << 20 | b
        order = np.argsort(key, kind="stable")
        return key[order], rank[order], made[order]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NONE where they make no piece) and places in the pair arrays."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE), at

    def _known_beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return self.beside[at] == key

    def merge_rounds(self, sym: np.ndarray, width: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge words of symbols until no pair is left: (symbols, their widths, symbols per word).

        ``first`` holds where words begin; ``width`` is any size of a symbol that adds up under merges.
        """
        n_words = len(first)
        word = np.zeros(len(sym), np.int64)
        word[first[1:]] = 1
        word = np.cumsum(word)
        place = np.arange(len(sym))
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank = np.full(len(sym), NONE)
        rank[inner] = self._pairs(sym[inner], sym[inner + 1])[0]
        ended: list[tuple[np.ndarray, ...]] = []
        while len(sym):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(begins, len(word)))
            least = np.minimum.reduceat(rank, begins)
            if (least >= NONE).any():
                stays = np.repeat(least < NONE, sizes)
                ended.append((place[~stays], sym[~stays], width[~stays], word[~stays]))
                sym, width, word, rank, place = sym[stays], width[stays], word[stays], rank[stays], place[stays]
                least, sizes = least[least < NONE], sizes[least < NONE]
                if not len(sym):
                    break
            pick = self._leftmost(np.flatnonzero(rank == np.repeat(least, sizes)))
            made = self.pair_made[self._pairs(sym[pick], sym[pick + 1])[1]]
            ready = self._in_turn(pick, made, sym, word, rank)
            pick, made = pick[ready], made[ready]
            sym[pick] = made
            width[pick] += width[pick + 1]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            new = pick - np.arange(len(pick))  # where merged symbols stand after compaction
            sym, width, word, rank, place = sym[keep], width[keep], word[keep], rank[keep], place[keep]
            last = np.append(word[1:] != word[:-1], True)
            before = new[new > 0] - 1
            for at in (new, before):
                inside = at[~last[at]]
                rank[at[last[at]]] = NONE
                rank[inside] = self._pairs(sym[inside], sym[inside + 1])[0]
        place, sym, width, word = (np.concatenate(c) for c in zip(*ended)) if ended else (place, sym, width, word)
        order = np.argsort(place)
        return sym[order], width[order], np.bincount(word, minlength=n_words)

    @staticmethod
    def _leftmost(pick: np.ndarray) -> np.ndarray:
        """Of places in a row, every other one, as the right half of a merge has no pair of its own."""
        runs = np.concatenate(([True], pick[1:] != pick[:-1] + 1))
        start = pick[np.flatnonzero(runs)][np.cumsum(runs) - 1]
        return pick[(pick - start) % 2 == 0]

    def _in_turn(self, pick: np.ndarray, made: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which picks may merge in this round: those of a word up to the first that makes a pair of no later rank."""
        of = word[pick]
        same = of[1:] == of[:-1]
        ready = np.ones(len(pick), bool)
        if not same.any():
            return ready
        many = np.flatnonzero(np.append(same, False))  # followed by another pick of the word
        at, own = pick[many], rank[pick[many]]
        early = np.zeros(len(many), bool)
        right = np.flatnonzero((at + 2 < len(sym)) & (word[np.minimum(at + 2, len(sym) - 1)] == word[at]))
        early[right] |= self._pairs(made[many][right], sym[at[right] + 2])[0] <= own[right]
        left = np.flatnonzero((at > 0) & (word[at - 1] == word[at]))
        before = many[left] - 1
        joined = (before >= 0) & (pick[before] == at[left] - 2)
        prev = np.where(joined, made[before], sym[at[left] - 1])
        early[left] |= self._pairs(prev, made[many][left])[0] <= own[left]
        if early.any():
            bad = np.zeros(len(pick), np.int64)
            bad[many[early]] = 1
            opens = np.concatenate(([True], ~same))
            before = np.cumsum(bad) - bad
            ready = before == before[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        return ready

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact tokens of words given as UTF-8 bytes in which a space stands for U+2581: flat ids and ids per word."""
        total = int(lengths.sum())
        data = buf[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(begins, total))
        sym = self.of_char[cps]
        opens = np.zeros(len(sym), bool)
        opens[np.searchsorted(begins, (np.cumsum(lengths) - lengths)[lengths > 0])] = True
        opens[1:] |= ~self._known_beside(sym[:-1], sym[1:])
        sym, width, _ = self.merge_rounds(sym, width, np.flatnonzero(opens))
        counts = np.where(sym < self.size, 1, width)
        tokens = np.repeat(sym, counts)
        spelt = np.flatnonzero(tokens >= self.size)
        if len(spelt):
            tokens[spelt] = self.byte_token[data[np.repeat(np.cumsum(width) - width, counts) + np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)]][spelt]
        ends = np.cumsum(width)
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(ends, np.cumsum(lengths), side="right")]
        return tokens, np.diff(np.concatenate(([0], upto)))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that aren't empty with a space before each: flat bytes and offsets."""
    full = (np.diff(offsets) > 0).astype(np.int64)
    shift = np.cumsum(full)
    out = np.full(len(data) + int(shift[-1]) if len(full) else 0, 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
    return out, offsets + np.concatenate(([0], shift))


def with_plain_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with each U+2581 as one space byte."""
    mark = SPACE.encode()
    at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return data, offsets
    keep = np.ones(len(data), bool)
    keep[at + 1] = keep[at + 2] = False
    out = data.copy()
    out[at] = 0x20
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


class PieceEncoder(Encoder):
    """Encodes slices of texts with the bounded cache of finished words."""

    def __init__(self, path: str):
        self.vocab = pieces(path)
        self._clear()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and id offsets by text, of texts given as flat UTF-8 bytes."""
        return self.encode_spaced(*with_plain_spaces(*spaced(data, offsets)))

    def encode_spaced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As a call, of texts that have their space in front and no U+2581."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.filled > STORE_MOST or len(self.longer) > 200_000:
            self._clear()
        opens = np.zeros(len(data), bool)
        opens[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        if self.vocab.spaces_open:
            blank = data == 0x20
            opens[1:] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(opens)
        off, cnt = self._look_up(data, starts, np.diff(np.append(starts, len(data))))
        idx = np.repeat(off - np.cumsum(cnt) + cnt, cnt) + np.arange(cnt.sum())
        return self.store[idx], np.concatenate(([0], np.cumsum(cnt)))[np.searchsorted(starts, offsets)]


def flat_of(table: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``ids`` in a table of byte strings, concatenated, and the length of each."""
    a, n = offsets[ids], np.diff(offsets)[ids]
    return table[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())], n


@lru_cache(2)
def decimals(size: int, end: str = ",") -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``size`` in decimal, each with ``end`` behind it, as a table of byte strings."""
    texts = [f"{i}{end}".encode() for i in range(size)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def decode(vocab: Pieces, ids: np.ndarray) -> str:
    """The text of ids without the space in front; bytes that aren't UTF-8 become replacement characters."""
    raw = flat_of(vocab.bytes_flat, vocab.byte_offsets, np.asarray(ids, np.int64))[0].tobytes()
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the piece ids of every whole text."""

    def make():
        encoder = PieceEncoder(path)

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
        encoder = PieceEncoder(path)
        vocab = encoder.vocab
        digits = decimals(vocab.size)

        def step(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                ids, offsets = encoder(*flat_bytes(part.column("text")))
                listed, widths = flat_of(*digits, ids)
                back, sizes = flat_of(vocab.bytes_flat, vocab.byte_offsets, ids)
                in_list = np.concatenate(([0], np.cumsum(widths)))[offsets].tolist()
                in_back = np.concatenate(([0], np.cumsum(sizes)))[offsets].tolist()
                listed, back = memoryview(listed), back.tobytes()
                sha, again = [], []
                for a, b, c, d in zip(in_list, in_list[1:], in_back, in_back[1:]):
                    sha.append(hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest())
                    text = back[c:d].removeprefix(b" ").decode("utf-8", "replace")
                    again.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(sha), pa.array(again)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

        return step

    return map_batches(documents_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
