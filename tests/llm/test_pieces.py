"""SentencePiece operators against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from corpusloom.llm import pieces, queries
from corpusloom.llm.common import flat_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PATH)


def encoded(encoder, texts):
    ids, offsets = encoder(*flat_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def odd_texts(library):
    rng = random.Random(11)
    vocab = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    out = ["", " ", "   ", "a", "▁", "▁▁a▁", "\0", "<s> </s> <unk> <0x0A>", "é​", "😀 梦梦", "=" * 999, "a" * 777, " " * 333, "ab" * 500]
    for _ in range(1500):
        n = int(rng.expovariate(1 / 20))
        out.append(rng.choice([
            "".join(rng.choice(vocab) for _ in range(n)),
            "".join(rng.choice("ab c\n\t=-") for _ in range(n)),
            "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x370, 0x500), rng.randrange(0x4E00, 0x5000), 0x2581, 0x1F600, 32])) for _ in range(n)),
            " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 12))) for _ in range(n)),
        ]))
    return out


def test_ids_and_texts_are_those_of_the_library(library, encoder):
    texts = odd_texts(library)
    for got, text in zip(encoded(encoder, texts), texts):
        want = library.encode(text)
        assert got == want
        assert pieces.decode(encoder.vocab, np.array(got)) == library.decode(want)


def test_words_longer_than_the_cache_and_without_spaces(library, encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(5_000)), "banana" * 3_000]
    assert encoded(encoder, texts) == [library.encode(t) for t in texts]


def test_rounds_hold_back_merges_whose_turn_comes_later():
    """Pairs of a word merge together only where one merge at a time would do the same."""
    vocab = object.__new__(pieces.Pieces)
    # b c -> 3 at rank 5; (bc) b -> 4 at rank 1, so the second b is gone before its own c comes
    vocab.pair_key, vocab.pair_rank, vocab.pair_made = pieces.Pieces._sorted([(1, 2, 5, 3), (3, 1, 1, 4)])
    sym, width, n = vocab.merge_rounds(np.array([1, 2, 1, 2, 1, 2]), np.ones(6, np.int64), np.array([0, 4]))
    assert sym.tolist() == [4, 2, 3] and width.tolist() == [3, 1, 2] and n.tolist() == [2, 1]


def test_query_digests(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_sentencepiece_round_trip(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "")
        listed, back = ",".join(map(str, ids)), library.decode(ids)
        assert got[doc_id] == (len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_odd_rows(spark, library):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "the cat", "z"), (2, "the cat", "z")], "doc_id int, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in pieces.encode(docs, PATH).collect())
    assert got == [(1, []), (1, []), (2, library.encode("the cat")), (2, library.encode("the cat"))]
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0
