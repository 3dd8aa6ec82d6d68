"""Alignment of two tokenizers against links found token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import alignment, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def plain():
    """Results of (doc_id, text) rows, by the libraries and plain loops over all token pairs."""
    a_lib = Tokenizer.from_file(BYTES)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of_letter = letters()

    def piece_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(size(i))))
            at += len(size(i))
        return out

    def run(rows):
        texts = []
        for doc_id, text in rows:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
            b = b_lib.encode(text) if text else []
            a_of = {i: bytes(of_letter[c] for c in a_lib.id_to_token(i)) for i in set(a)}
            b_of = {i: piece_bytes(i) for i in set(b)}
            whole = (" " + text).encode() if text else b""
            if b"".join(a_of[i] for i in a) != whole or b"".join(b_of[i] for i in b) != whole:
                a, b = [], []
            texts.append((doc_id, spans(a, a_of.get), spans(b, b_of.get)))
        links = [[(i, k) for i, x, y in a for k, u, v in b if x < v and u < y] for _, a, b in texts]
        counts = Counter(p for of in links for p in of)
        most = Counter()
        for (_, k), n in counts.items():
            most[k] = max(most[k], n)
        out = []
        for (doc_id, a, b), of in zip(texts, links):
            cuts = sorted({y for _, _, y in a} & {v for _, _, v in b})
            groups = [(",".join(str(i) for i, _, y in a if lo < y <= hi), ",".join(str(k) for k, _, v in b if lo < v <= hi)) for lo, hi in zip([0, *cuts], cuts)]
            listed = ";".join(f"{x}|{y}" for x, y in groups)
            best = sum(counts[p] == most[p[1]] for p in of)
            out.append((doc_id, len(a), len(b), len(groups), len(of), best, sum(counts[p] for p in of), hashlib.sha256(listed.encode()).hexdigest() if listed else ""))
        return sorted(out)

    return run


def test_against_all_pairs_of_tokens(spark, plain, monkeypatch):
    rng = random.Random(2)
    words = ["the", "of", "ingen", "thation", "été", "naïve", "日本語", "<|endoftext|>", "<s>", "x=1;", "\n\n", "  ", "12345", "👍"]
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (4, "the of"), (4, "the of"), (5, "<|endoftext|>"), (6, "\0")]
    rows += [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(10, 120)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, pairs string, row string").repartition(5)
    monkeypatch.setattr(alignment, "MOST_ROWS", 7)
    got = sorted(tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect())
    assert got == plain(rows)


def test_common_ids_go_over_several_ranges():
    ids, first, spread = alignment.ranges({7: 5, 9: 900, 11: 5, 30: 90}, 10)
    assert ids.tolist() == [7, 9, 11, 30] and first.tolist() == [0, 0, 9, 9] and spread.tolist() == [1, 10, 1, 1]


def test_query(spark, sf, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if not r[1] or len(r[1]) < 1500]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect()) == plain(short)
    got = queries.op12_tokenizer_alignment(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got)


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0
