"""Suffix arrays, SimHash, the multi-index and the pipeline: against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm import multi_index, simhash, suffix_dedup
from pyspark.sql import functions as F


def repeats(rows, window=50):
    """Every window of every document, smaller ids first."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: float("inf") if r[0] is None else r[0])
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], i)
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] != i:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, n_bytes int")
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, **options).collect()]


def mosaic(seed, n, letters="abcd "):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(400)) for _ in range(5)]
    rows = []
    for k in range(n):
        text = ""
        for _ in range(rnd.randint(0, 6)):
            b, a = rnd.choice(base), rnd.randint(0, 340)
            text += b[a : a + rnd.randint(20, 150)]
            if rnd.random() < 0.4:
                text += "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
        rows.append((k * 7 % 1009, text))
    return rows


@pytest.mark.parametrize("rows", [
    [(0, "a" * 200), (1, "a" * 120), (2, "b" * 49), (3, "b" * 50), (4, "b" * 51), (5, None), (6, ""), (7, "x" * 30 + "b" * 50 + "y"), (8, "ab" * 100), (9, "ba" * 100), (10, "é" * 60), (11, "é" * 60 + "a" * 60)],
    mosaic(1, 200), mosaic(2, 120, "ab"), [(k, "z" * 75 + str(k) * 40) for k in range(60)],
    [(5, "same text " * 30), (5, "same text " * 30), (9, "same text " * 30), (None, "same text " * 30), (None, "q" * 80)],
])
def test_repeats(spark, rows):
    assert sorted(removed(spark, rows), key=str) == sorted(repeats(rows), key=str)


def test_repeats_in_small_parts(spark, monkeypatch):
    """A chunk's blocks and texts become rows a few at a time, with the same result."""
    monkeypatch.setattr(suffix_dedup, "SENT_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "KEPT_ROWS", 3)
    rows = [*mosaic(3, 150), (2000, None), (2001, ""), (2002, "é" * 60), (2003, "é" * 60)]
    assert sorted(removed(spark, rows), key=str) == sorted(repeats(rows), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    digests = {i: digest for i, *_, digest in repeats(rows)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()} == digests


@pytest.mark.parametrize("gram", [1, 7, 20, 50])
def test_any_gram_gives_the_same(spark, gram):
    rows = mosaic(3, 60)
    assert sorted(removed(spark, rows, gram=gram)) == sorted(repeats(rows))


@pytest.mark.parametrize("hot_chunks, slab", [(0, 150_000), (2, 150_000), (256, 20)])
def test_hot_anchors_and_large_groups(spark, monkeypatch, hot_chunks, slab):
    monkeypatch.setattr(suffix_dedup, "SLAB", slab)
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefg ") for _ in range(130))
    tail = lambda: "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 60)))
    rows = [(k, tail() + passage[rnd.randint(0, 20) : rnd.randint(70, 130)] + tail()) for k in range(150)] + [(k + 500, t) for k, t in mosaic(8, 60)]
    assert sorted(removed(spark, rows, hot_chunks=hot_chunks)) == sorted(repeats(rows))


def test_small_pieces_and_long_texts(spark, monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, text), (2, text[10_000:25_000] + "!" + text[:300]), (3, text[::-1])]
    assert sorted(removed(spark, rows)) == sorted(repeats(rows))
    chunk = suffix_dedup.Chunk(__import__("pyarrow").table({"doc_id": [1, 2], "text": [text, text[:500]]}))
    whole = {(a + s, n) for a, b, _ in chunk.pieces(50, 20) for s, n in zip(b.start, b.size)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    cut = [(a + s, n) for a, b, _ in chunk.pieces(50, 20) for s, n in zip(b.start, b.size)]
    assert sum(n for _, n in cut) == sum(n for _, n in whole)


def test_text_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "k" * 60, "en", 60), (2, "k" * 60 + "tail", "de", 64)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    assert suffix_dedup.without_repeats(df).columns == df.columns
    assert got[2]["text"] == "tail" and got[2]["n_chars"] == 4 and got[2]["lang"] == "de" and got[1]["text"] == "k" * 60
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_clashing_columns_are_carried(spark):
    names = ["chunk", "slot", "carried", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256", "odd name-1"]
    df = spark.createDataFrame([(k, "k" * 60 if k < 2 else None, *range(k, k + len(names))) for k in range(4)], "doc_id int, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    assert suffix_dedup.without_repeats(df).schema.simpleString() == df.schema.simpleString()
    assert got[0]["text"] == "k" * 60 and got[1]["text"] == "" and all([got[k][n] for n in names] == list(range(k, k + len(names))) for k in range(4))


def test_more_chunks_than_partitions(spark):
    rows = mosaic(11, 80) + [(None, "q" * 90 + str(k)) for k in range(20)]
    assert sorted(removed(spark, rows, chunk_bytes=800), key=str) == sorted(repeats(rows), key=str)


def test_multikey_sort():
    x = np.random.default_rng(0).integers(0, 3, (500, 4)).astype(np.uint64)
    order, same = suffix_dedup.multikey_sort(x)
    rows = [tuple(r) for r in x[order].tolist()]
    assert rows == sorted(map(tuple, x.tolist())) and same.tolist() == [False] + [a == b for a, b in zip(rows[1:], rows)]


def slow_fingerprint(text):
    import re

    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", " \n", "One", "A b C", "a b c d", "a\x0bb\x0cc\xa0d e " * 50, "É é " * 9, "w " * 30_000]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def linked(values, budget=4):
    d = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in d])
        if (new == label).all():
            return label
        label = new


def test_trie_and_tables_find_every_link():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 150, dtype=np.uint64)
    all_ = [v]
    for _ in range(8):
        x = v.copy()
        for _ in range(int(rng.integers(1, 7))):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        all_.append(x)
    v = np.unique(np.concatenate(all_))
    want = linked(v)
    assert (simhash.trie_forest(v, np.array([0]), np.array([len(v)]), 0) == want).all()
    parent = np.arange(len(v))
    for bits, moves in simhash.tables():
        pv = simhash.permuted(v, moves)
        order = np.argsort(pv)
        key = pv[order] >> np.uint64(64 - bits)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        root = simhash.trie_forest(pv[order], start, np.append(start[1:], len(key)), bits)
        simhash._settle(parent, order, order[root])
    assert (parent == want).all()


def test_dense_ball():
    v = np.array(sorted({(1 << a) | (1 << b) for a in range(64) for b in range(64)}), np.uint64)
    assert (simhash.trie_forest(v, np.array([0]), np.array([len(v)]), 0) == 0).all()


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()] + [(900, None), (901, ""), (902, " "), (3, "again"), (None, "null id")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    comp = linked(fp)
    least = {c: min((i for (i, _), k in zip(rows, comp) if k == c and i is not None), default=None) for c in set(comp)}
    want = sorted((str(i), f"{f:016x}", str(least[c])) for (i, _), f, c in zip(rows, fp.tolist(), comp))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {i for i in ids if i is not None} == {x for x in least.values() if x is not None}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()


def test_large_buckets_are_dealt_anew(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    v = np.unique(np.concatenate([np.bitwise_xor(b, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for b in base]))
    v = np.unique(np.concatenate([v, rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    want = linked(v)
    for most in (150, 200_000):
        edges = [(r["a"], r["b"]) for r in simhash.links(df, bucket_rows=most).collect()]
        at = {int(x): k for k, x in enumerate(v.view(np.int64))}
        parent = np.arange(len(v))
        simhash._settle(parent, np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
        assert (parent == want).all()


def five_word_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_stage_against_all_pairs(spark, sf):
    import corpus_pipeline as p

    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("aeiou") + str(rnd.randint(0, 40))
    line = [word() for _ in range(60)]
    texts = [None, "", " ", "one two", "ONE  two", "one two three four five"]
    for k in range(25):
        base = [word() for _ in range(rnd.randint(10, 250))] + (line if k % 3 == 0 else [])
        for _ in range(5):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hub = [word() for _ in range(80)]
    texts += [" ".join([*hub, word(), word()]) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rnd.shuffle(texts)
    sets = [five_word_sets(t) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = dict(p.STAGES)["near_duplicates"](spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp))
    assert dict(p.STAGES)["near_duplicates"](spark, docs.limit(0), sf).count() == 0


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 201)], "a long, b long")
    for few in (0, simhash.FEW_EDGES):  # by rounds over all tasks, and in one task
        got = [(r["node"], r["root"]) for r in simhash.components(edges, few).collect()]
        assert len(got) == 63 and dict(got) == {k: 0 for k in range(61)} | {200: 200, 201: 200}
    assert simhash.components(edges.limit(0)).count() == 0


def searched(got):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(f) for q, f in by.items()}


def recall_of(x, ids, by):
    """Share of the ten nearest that were found, ties by the smaller id; ranks and scores are checked."""
    hits = total = 0
    for q, found in by.items():
        at = ids.index(q)
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        best = [ids[k] for k in np.lexsort((ids, d)).tolist() if k != at][:10]
        place = {i: k for k, i in enumerate(ids)}
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1)) and all(abs(d[place[k]] - s) < 1e-12 for _, k, s in found)
        hits += len(set(best) & {k for _, k, _ in found})
        total += len(best)
    return hits / total


def test_multi_index_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:900] = x[0]  # a third is one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] + [1.0] * 15), (5400, [None] + [1.0] * 15), (5500, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    by = searched(multi_index.search(df, F.col("vec_id") % 100 == 0, words=16, sample=1000).collect())
    assert set(by) == set(range(0, 3000, 100))
    assert recall_of(x.astype(float), list(range(3000)), by) >= 0.9
    for q in range(0, 900, 100):  # of equal vectors the smallest ids
        assert [k for _, k, _ in by[q]] == [k for k in range(12) if k != q][:10]
    few = multi_index.search(df.where("vec_id in (0, 950, 960)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [950, 960]
    assert multi_index.search(df.limit(0), F.lit(True)).count() == 0
    assert multi_index.search(df.where("vec_id = 7"), F.lit(True)).count() == 0


def test_multi_index_on_given_and_clustered_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null")
    rows = [(r[0], r[1]) for r in given.select("vec_id", "embedding").collect()]
    by = searched(multi_index.search(given, F.col("vec_id") % 100 == 0).collect())
    assert recall_of(np.array([v for _, v in rows], float), [i for i, _ in rows], by) >= 0.9
    assert multi_index.shortlist_size(len(rows), 10) <= 0.05 * len(rows)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    touched = spark.sparkContext.accumulator(0)
    by = searched(multi_index.search(df, F.col("vec_id") % 100 == 0, words=32, touched=touched).collect())
    assert len(by) == 60 and recall_of(x, list(range(6000)), by) >= 0.9
    assert 0 < touched.value < 0.05 * 60 * 6000  # clusters are met early, and only their entries are compared


def test_multi_index_ranks_equal_vectors_equally_in_any_company():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 30))
    x[::7] = x[3]
    book = multi_index.Codebooks(x, 16, 5, 10, 0.9)
    whole = book.cells(x), book.codes(x, book.cells(x))
    for some in (slice(3, 4), slice(0, 50), slice(7, 400)):
        cell = book.cells(x[some])
        assert (cell == whole[0][some]).all() and (book.codes(x[some], cell) == whole[1][some]).all()
        assert (book.rests(cell, whole[1][some]) == book.rests(*whole)[some]).all()
        assert all((a[some] == b).all() for a, b in zip(book.to_words(x) + tuple(book.tables(x)), book.to_words(x[some]) + tuple(book.tables(x[some]))))
    assert len(set(book.rests(*whole)[::7])) == 1


def test_multi_index_repeated_rows_and_large_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, x[100].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") % 100 == 0, words=8).collect()
    of = [r for r in got if r["query_id"] == 100]
    y = np.array([v for _, v in rows])
    want = [rows[k][0] for k in np.lexsort(([i for i, _ in rows], np.sqrt(((y - y[100]) ** 2).sum(1)))).tolist()][1:11]
    assert sorted(r["rank"] for r in of) == sorted(2 * list(range(1, 11))) and [r["vec_id"] for r in sorted(of, key=lambda r: r["rank"])][::2] == want
    big = spark.createDataFrame([(k, (v * 1e200).tolist()) for k, v in enumerate(x)] + [(500, [1.0] * 8)], "vec_id long, embedding array<double>")
    by = searched(multi_index.search(big, F.col("vec_id") % 100 == 0, words=8).collect())
    d = 1e200 * np.sqrt(((x - x[0]) ** 2).sum(1))
    assert set(by) == {0, 100, 500} and all(len(f) == 10 for f in by.values()) and all(k == 500 or abs(s / d[k] - 1) < 1e-12 for _, k, s in by[0])


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = out.count()
        assert 0 < kept <= before
        before, docs = kept, out
    assert p.run(spark, sf).groupBy("doc_id").count().count() == before


CLASHES = "chunk slot carried n_bytes kept_text score predicted held_out fp key bits prefix component_id __copies __id bucket token ids sequence_id lang_pred".split()


def odd_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    text = rows[5][1]
    rows += [(900, None, None, "s", 0), (901, "", "en", "s", 0), (902, "123 !!", "en", "s", 7), (903, text, "en", None, 1), rows[5], rows[5], (None, text + " tail", "en", "s", 1), (5, "a text of its own with id five", "en", "s", 1), (904, "k " * 100_000, "en", "s", 200_000)]
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))


def test_stages_on_odd_rows_against_plain_results(spark, sf):
    import corpus_pipeline as p
    from corpusloom.llm import langid, packing, toxicity
    from corpusloom.llm.common import table
    from corpusloom.llm.queries import TOKENIZER
    from tokenizers import Tokenizer

    docs = odd_documents(spark, sf).cache()
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(p.STAGES)
    sort = lambda x: sorted(map(str, x))

    out = stages["toxicity"](spark, docs, sf)
    scores = toxicity.classify(docs, table(spark, sf, "labels")).collect()
    kept = [r for r, s in zip(rows, scores) if s["predicted"] == 0]
    assert all(s["doc_id"] == r[0] for r, s in zip(rows, scores)) and sort(map(tuple, out.collect())) == sort(kept)

    out = stages["language"](spark, docs, sf)
    accepted = [r["accepted"] for r in langid.identify(docs).collect()]
    assert sort(map(tuple, out.collect())) == sort(r for r, a in zip(rows, accepted) if a)
    assert not [r for r, a in zip(rows, accepted) if a and r[1] in (None, "", "123 !!")]

    out = stages["near_duplicates"](spark, docs, sf)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and len(ids) - ids.count(None) == len({i for i in ids if i is not None}) and ids.count(None) == 1 and 903 not in ids and 901 not in ids

    out = stages["repeated_passages"](spark, docs, sf)
    got = [(r["doc_id"], len(r["text"].encode())) for r in out.collect()]
    assert out.schema.simpleString() == docs.schema.simpleString() and len(got) == len(rows)
    left = sorted((str(i), n - gone) for i, n, gone, _, _ in repeats([(r[0], r[1] if r[0] != 904 else None) for r in rows]) if i != 904)
    assert [x[0] for x in left] == sorted(str(i) for i, _ in got if i != 904)
    assert all(a[1] - b[1] in (0, 1, 2, 3) for a, b in zip(left, sorted((str(i), n) for i, n in got if i != 904)))  # a cut character goes whole

    library = Tokenizer.from_file(TOKENIZER)
    pieces = {}
    for r in packing.pack(docs.where("doc_id >= 900"), TOKENIZER).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, text in [(r[0], r[1]) for r in rows if (r[0] or 0) >= 900]:
        assert [x for _, part in sorted(pieces[i]) for x in part] == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_texts_that_changed_too_much_of_one_original_do_not_meet(spark, monkeypatch):
    from corpusloom.llm import shingle_join

    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(40):
        words = list(base)
        for at in (5 + k % 7, 35 + k % 11, 65 + k % 13, 95 + k % 17):  # 20 of 116 shingles each
            words[at] = f"own{k}_{at}"
        texts.append(" ".join(words))
    held = []

    def counted(df):
        out = real(df)
        if "token" in out.columns:
            held.append(out.count())
        return out

    real = shingle_join.cut
    monkeypatch.setattr(shingle_join, "cut", counted)
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:2], texts[3] + " more"])), "doc_id long, text string")
    found = dict(shingle_join.near_duplicates(docs).collect())
    assert found == {**{k: k for k in range(40)}, 40: 0, 41: 1, 42: 3}
    assert held == [0]


def test_multi_index_recall_of_vectors_of_many_lengths(spark):
    """Short vectors lie closer together than codes made for long ones can tell."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x *= 10.0 ** rng.uniform(-5, 3, size=(6000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    hits = 0
    for r in multi_index.search(df, F.col("vec_id") % 100 == 0).collect():
        far = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        far[r.query_id] = np.inf
        hits += r.score <= np.sort(far)[9] * (1 + 1e-12)
    assert hits >= 0.9 * 600


def rows_made(spark, first):
    """The most rows that a join, a generator or a Python step made in the plans from the ``first`` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(first, runs.size()):
        at = runs.apply(k).executionId()
        values = {int(i): v for i, v in dict(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionMetrics(at))).items()}
        nodes = store.planGraph(at).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if any(x in node.name() for x in ("Join", "Generate", "Arrow")):
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows":
                        most = max(most, int(values.get(m.accumulatorId(), "0").replace(",", "") or 0))
    return most


def test_pairs_of_a_group_stay_in_its_task(spark, monkeypatch):
    """Mosaics of the same passages share their first shingles with many others and are similar to few."""
    from corpusloom.llm import shingle_join

    rnd = random.Random(8)
    passages = [[f"p{k}w{i}" for i in range(10)] for k in range(16)]
    texts = [" ".join(w for k in sorted(rnd.sample(range(16), 8)) for w in passages[k]) for _ in range(700)]
    texts = list(dict.fromkeys(texts))
    texts += [texts[k] + f" more{k}" for k in range(0, 40, 2)]
    sets = [five_word_sets(t) for t in texts]
    comp = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if comp[i] != comp[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert dict(shingle_join.near_duplicates(docs).collect()) == dict(enumerate(comp))
    assert rows_made(spark, first) <= sum(map(len, sets))  # as many as the texts have shingles
    monkeypatch.setattr(shingle_join, "GROUP_ROWS", 7)  # in blocks
    monkeypatch.setattr(shingle_join, "FAMILY", 300)
    assert dict(shingle_join.near_duplicates(docs).collect()) == dict(enumerate(comp))
