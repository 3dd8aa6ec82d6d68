"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    terms = [(i, Counter(TERM.findall(t.translate(ASCII)) if t else [])) for i, t in docs if i is not None]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall(text.translate(ASCII)) if text else []), []
        for i, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            scores.append((-sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c), i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return sorted(out)


def test_against_every_score(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "The", "of", "été", "ÉTÉ", "x9", "k" * 17, "k" * 18, "abcdefgh", "abcdefghi", "İ", "日本"] + [f"w{i}" for i in range(40)]
    mark = [" ", "-", "\n", ". ", "\0", " ", "_"]

    def text(n):
        return "".join(w + rng.choice(mark) for w in rng.choices(words, [30, 9, 9] + [1] * (len(words) - 3), k=n))

    docs = [(i // 2 * 2, text(rng.randrange(0, 30))) for i in range(300)] + [(900, None), (901, ""), (902, "... !"), (None, "the w1")]
    docs += [(1000 + i, docs[7][1]) for i in range(15)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(20)] + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (50, None), (51, "?"), (52, "nowhere")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(4)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 200)
    monkeypatch.setattr(lexical, "MOST_ROWS", 31)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 9)
    assert sorted(tuple(r) for r in lexical.search(frame, asked).collect()) == plain(docs, items)


def block_of(rng, n_docs, n_terms):
    rows = sorted({(rng.randrange(n_docs), min(int(rng.expovariate(0.15)), n_terms - 1)) for _ in range(n_docs * 12)})
    doc, term = (np.array(c, np.int64) for c in zip(*rows))
    weight = np.array([1 + 900 * t // n_terms for t in range(n_terms)])
    return lexical.Block(np.arange(n_docs), doc, term, weight[term] * np.array([rng.randrange(1, 5) for _ in rows]), n_terms)


def test_blocks_stop_early_and_stay_exact():
    rng = random.Random(8)
    block, total = block_of(rng, 4_000, 60), 0
    for _ in range(50):
        terms = np.array(sorted(rng.sample(range(60), 8)))
        times = np.array([rng.randrange(1, 3) for _ in terms])
        ids, score = block.best(terms, times, 10, 1)
        want = np.zeros(4_000, np.int64)
        for t, q in zip(terms, times):
            own = block.term == t
            want[block.doc[own]] += q * block.impact[own]
            total += own.sum()
        order = np.lexsort((np.arange(4_000), -want))[:10]
        assert ids.tolist() == order.tolist() and score.tolist() == want[order].tolist()
    assert block.taken < 0.8 * total


def test_query_against_every_score(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_ranked_lexical_search(spark, sf).collect()) == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0
