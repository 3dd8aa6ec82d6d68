"""Ranked lexical search by exact impacts.

A posting's impact is what one occurrence of its term in a query adds to a document's
score, an integer.  Documents are indexed block by block: postings of a term are grouped by
equal impact, highest first.  A query takes the groups of all its terms in descending
order, score at a time, and adds them to its documents.  What the groups not yet taken could
add to any document at most is known at each step; once that is less than the k-th best
score so far, no document that was not met can enter.  Scores of the documents that still
can are then completed from the documents' own postings, so results are exact.

Two passes over documents: the first counts terms (of the queries only, whose vocabulary is
as large as the query block) and writes the postings; the second ranks each block within
its task, and only the k best of a task and query are shuffled.  Queries are taken in blocks
of bounded rows and bytes, which bounds what is sent to tasks.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with only A to
Z lower-cased.

Defined cases: null and empty texts have no term, and neither do texts of marks alone; they
aren't counted as documents, nor are rows without a doc_id; a query without terms, or whose terms no document has, gets no
rows; repeated documents are each ranked, repeated queries each answered; equal scores go by
ascending doc_id; documents with score zero aren't returned; empty tables give no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, flat_bytes, map_batches, slices, written

#: Queries that are answered in one pass: at most about this many rows and bytes.
BLOCK_QUERIES = 5_000
BLOCK_BYTES = 32 << 20
#: Postings that a task indexes at once.
BLOCK_POSTINGS = 3_000_000
#: Rows of a slice at most, so that places in it are 16 bits.
MOST_ROWS = 50_000
#: The first step takes this share of a query's postings; each later one as many as all before.
FIRST_STEP = 64

INDEX = "doc_ids array<long>, sizes array<long>, docs binary, terms binary, times binary, own array<long>, own_docs array<long>"
IN_TERM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def terms_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of texts, and where terms begin and how long they are."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return LOWER[data], starts, ends - starts


def terms_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    low, starts, lengths = terms_in(data, np.array([0, len(data)]))
    raw = low.tobytes()
    return [raw[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]


class Terms:
    """A vocabulary that is looked up by arrays: up to 16 bytes by two numbers, longer terms by name."""

    def __init__(self, terms: list[bytes]):
        self.longer = {t: i for i, t in enumerate(terms) if len(t) > 16}
        short = [(t, i) for i, t in enumerate(terms) if len(t) <= 16]
        self.lo = np.array([int.from_bytes(t[:8], "little") for t, _ in short], np.uint64)
        self.hi = np.array([int.from_bytes(t[8:], "little") for t, _ in short], np.uint64)
        self.size = np.array([len(t) for t, _ in short], np.int64)
        self.number = np.array([i for _, i in short], np.int64)
        self.seed = 0
        while len(np.unique(self._mixed(self.lo, self.hi, self.seed))) < len(np.unique(np.stack([self.lo, self.hi], 1), axis=0)):
            self.seed += 1  # two terms must not share a hash
        order = np.argsort(self._mixed(self.lo, self.hi, self.seed), kind="stable")
        self.lo, self.hi, self.size, self.number = self.lo[order], self.hi[order], self.size[order], self.number[order]
        self.hash = self._mixed(self.lo, self.hi, self.seed)

    @staticmethod
    def _mixed(lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
        x = (lo + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) ^ hi * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each term given as a span of bytes, or -1."""
        out = np.full(len(starts), -1, np.int64)
        buf = np.concatenate((data, np.zeros(16, np.uint8)))
        eights = np.ndarray((len(data) + 8,), "<u8", buf.data, strides=(1,))
        short = np.flatnonzero(lengths <= 16)
        if len(self.hash) and len(short):
            s, n = starts[short], lengths[short].astype(np.uint64)
            full, eight = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(8)
            lo = eights[s] & (full >> eight * (eight - np.minimum(n, eight)))
            hi = np.where(n > eight, eights[np.minimum(s + 8, len(data))] & (full >> eight * (eight - np.clip(n, 9, 16) + eight)), np.uint64(0))
            key = self._mixed(lo, hi, self.seed)
            at = np.minimum(np.searchsorted(self.hash, key), len(self.hash) - 1)
            hit = (self.lo[at] == lo) & (self.hi[at] == hi) & (self.size[at] == lengths[short])
            out[short[hit]] = self.number[at[hit]]
        if self.longer:
            long_ = np.flatnonzero(lengths > 16)
            out[long_] = [self.longer.get(data[a : a + n].tobytes(), -1) for a, n in zip(starts[long_].tolist(), lengths[long_].tolist())]
        return out


def indexed(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """One row for each slice of documents: ids, numbers of terms, postings of the vocabulary, and its terms with document counts."""

    def make():
        table = Terms(vocabulary)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in (p.slice(k, MOST_ROWS) for p in slices(batch, "text") for k in range(0, p.num_rows, MOST_ROWS)):
                data, offsets = flat_bytes(part.column("text"))
                low, starts, lengths = terms_in(data, offsets)
                sizes = np.diff(np.searchsorted(starts, offsets))
                number = table.find(low, starts, lengths)
                known = np.flatnonzero(number >= 0)
                text = np.searchsorted(offsets, starts[known], side="right") - 1
                both, times = np.unique(text << 32 | number[known], return_counts=True)
                own, own_docs = np.unique(both & 0xFFFFFFFF, return_counts=True)
                arrays = [np.asarray(part.column("doc_id")), sizes, own, own_docs]
                ids, sizes_, own, own_docs = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int64))) for x in arrays)
                raw = [pa.array([x.tobytes()], pa.binary()) for x in ((both >> 32).astype("<u2"), (both & 0xFFFFFFFF).astype("<u4"), times.astype("<u4"))]
                yield pa.record_batch([ids, sizes_, *raw, own, own_docs], names=[c.split()[0] for c in INDEX.split(", ")])

        return step

    return map_batches(documents_of(docs), make, INDEX)


class Block:
    """Postings of some documents, by document, and by term in groups of equal impact, highest first."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.doc_ids, self.doc, self.term, self.impact = doc_ids, doc, term, impact
        self.of_doc = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
        self.order = np.lexsort((-impact, term))
        t, i = term[self.order], impact[self.order]
        self.group = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])))) if len(t) else np.zeros(0, np.int64)
        self.group_end = np.append(self.group[1:], len(t))
        self.group_impact = i[self.group]
        self.of_term = np.searchsorted(t[self.group], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, np.int64)  # of the query at hand
        self.taken = 0  # postings added so far, for tests and reports

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of the k best of this block that may be among the best k where ``least`` is to be reached."""
        a, n = self.of_term[terms], self.of_term[terms + 1] - self.of_term[terms]
        group = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        if not len(group):
            return self.doc_ids[:0], np.zeros(0, np.int64)
        adds = np.repeat(times, n) * self.group_impact[group]
        following = np.append(adds[1:], 0)
        following[np.cumsum(n)[n > 0] - 1] = 0
        turn = np.argsort(-adds, kind="stable")
        left = int(adds[(np.cumsum(n) - n)[n > 0]].sum()) - np.cumsum((adds - following)[turn])  # what a document may still get behind each group
        width = (self.group_end - self.group)[group][turn]
        upto = np.cumsum(width)
        score, at, take = np.zeros(len(self.doc_ids), np.int64), 0, max(k, int(upto[-1]) // FIRST_STEP)
        while True:
            to = min(len(turn), int(np.searchsorted(upto, take)) + 1)
            g, w = group[turn[at:to]], width[at:to]
            place = np.repeat(self.group[g] - np.cumsum(w) + w, w) + np.arange(w.sum())
            np.add.at(score, self.doc[self.order[place]], np.repeat(adds[turn[at:to]], w))
            self.taken += len(place)
            if len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
            at, rest = to, int(left[to - 1])
            if at == len(turn) or rest < least:
                break
            take = 2 * int(upto[to - 1])
        found = np.flatnonzero((score > 0) & (score + rest >= least))
        if rest:
            score[found] = self._completed(found, terms, times)
            found = found[(score[found] > 0) & (score[found] >= least)]
        first = np.lexsort((self.doc_ids[found], -score[found]))[:k]
        return self.doc_ids[found[first]], score[found[first]]

    def _completed(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        a, n = self.of_doc[docs], self.of_doc[docs + 1] - self.of_doc[docs]
        place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.weight[terms] = times
        sums = np.concatenate(([0], np.cumsum(self.weight[self.term[place]] * self.impact[place])))
        self.weight[terms] = 0
        return sums[np.cumsum(n)] - sums[np.cumsum(n) - n]


def impacts(times: np.ndarray, weights: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence in a query adds; all in 64-bit integers."""
    m = 100 - 75 + (75 * sizes * n_docs) // n_terms
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def answers(docs: DataFrame, asked: list[tuple[int, str]], k: int) -> DataFrame | None:
    """(place, doc_id, score): each task's best of every query of ``asked``, a bounded list of (place, text)."""
    wanted = [(place, Counter(terms_of(text or ""))) for place, text in asked]
    vocabulary = sorted({t for _, terms in wanted for t in terms})
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = [(place, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for place, c in wanted if c]
    index = written(indexed(docs, vocabulary), "lexical-index")
    sizes = index.select(F.explode("sizes").alias("n")).where("n > 0").agg(F.count("n").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sizes["docs"], sizes["terms"]
    if not n_docs:
        return None
    df = index.select(F.explode(F.arrays_zip("own", "own_docs")).alias("t")).groupBy(F.col("t.own").alias("term")).agg(F.sum("t.own_docs").alias("n")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)  # one number for each term of the queries
    for term, n in zip(df.column("term").to_pylist(), df.column("n").to_pylist()):
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            doc_ids, n, doc, term, times = (np.concatenate(c) for c in zip(*held))
            held.clear()
            block = Block(doc_ids, doc, term, impacts(times, weights[term], n[doc], n_docs, n_terms), len(vocabulary))
            for place, terms, counts in queries:
                ids, score = best.get(place, (doc_ids[:0], np.zeros(0, np.int64)))
                more, their = block.best(terms, counts, k, int(score[k - 1]) if len(score) >= k else 1)
                ids, score = np.concatenate((ids, more)), np.concatenate((score, their))
                first = np.lexsort((ids, -score))[:k]
                best[place] = ids[first], score[first]

        docs_held = postings_held = 0
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, n = (np.asarray(batch.column(c)[r].values, dtype=np.int64) for c in (0, 1))
                doc, term, times = (np.frombuffer(batch.column(c)[r].as_py(), kind).astype(np.int64) for c, kind in ((2, "<u2"), (3, "<u4"), (4, "<u4")))
                held.append((doc_ids, n, doc + docs_held, term, times))
                docs_held, postings_held = docs_held + len(doc_ids), postings_held + len(doc)
                if postings_held >= BLOCK_POSTINGS:
                    settle()
                    docs_held = postings_held = 0
        if held:
            settle()
        for place, (ids, score) in best.items():
            yield pa.record_batch([pa.array(np.full(len(ids), place)), pa.array(ids), pa.array(score)], names=["place", "doc_id", "score"])

    return index.select("doc_ids", "sizes", "docs", "terms", "times").mapInArrow(rank, "place long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of ``queries``."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull())
    asked = written(queries.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_QUERIES), -(-size["bytes"] // BLOCK_BYTES))
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).select("place", "text").collect()
        found.append(answers(docs, [tuple(r) for r in rows], k))
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("place").orderBy(F.desc("score"), "doc_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("place", "item_id"), "place").select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark
), wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact
  FROM postings JOIN sizes USING (doc_id) JOIN weights USING (term), whole
), scores AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
