"""Near-duplicates by SimHash candidates and the exact Jaccard similarity of word shingles.

All pairs of texts whose sets of five-word shingles have a similarity of at least
``LEAST`` are linked, and none else.  The candidates come in three steps, each
checked against the texts' whole sets:

1. The binary-trie self-join of ``simhash`` over fingerprints of the same shingles.
   Most near copies are linked here, but fingerprints of texts at a similarity of 0.8
   differ by about ten of 64 bits, which no trie walk can reach, so
2. texts that share a rare shingle follow.  Shingles have one order for all texts,
   those that a sample holds often last; the smallest common shingle of two similar
   texts lies among the first n - ceil(0.8 n) + 1 of each (prefix filter), and among the
   first n / 9 + 1 of the smaller.  Under every shingle a text is compared with the text
   in which it comes earliest, as that has fewest shingles of its own, and then with its
   neighbour by size, if they lie in different components yet.
3. Texts of different components that still share such a shingle, early in the smaller text,
   are sent to one task with their parity bits, folded to half, and compared there: a row
   leaves it only for a pair whose sizes and bits allow it.  So what is shuffled grows with the
   texts, whereas the pairs of a group grow with its square.  Shingles that the same texts
   share count as one, and a large group is dealt in blocks to several tasks.  Texts that
   changed too much of a common original to be similar keep its shingles behind their own
   ones, and so don't meet.

The sample decides the order alone, which any order would serve.  A shingle that
the sample holds often is split over several tasks in step 2.

Each set also has parity bits, one for each class of hashes and at least as many as shingles.
At least as many shingles differ as parity bits do, so pairs well over the limit are dropped
before their shingles are moved.

Defined cases: a text of fewer words than a shingle is one shingle; null and blank
texts are equal to each other and to no other; equal sets are linked; a text of any
length counts whole; rows without a doc_id take no part, and ``keep_one`` keeps them;
repeated rows are repeated in ``near_duplicates``, and of rows that repeat a kept
doc_id ``keep_one`` keeps one; an empty table gives an empty result; other columns,
whatever their names, are carried by ``keep_one`` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents_of, free_shuffles, map_batches, release, shuffle_partitions, slices, written
from .simhash import components, keep_first, links, majority, shingle_hashes, with_class

WORDS = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: 64-bit words of a set's parity bits at least.
PARITY = 4
SAMPLE_ROWS = 20_000
MOST_HEAVY = 200_000
#: Texts that share a shingle and are compared in one task, about.
SHARE_ROWS = 20_000
#: Texts that share a shingle and lie in one block of a group; 64-bit words that are compared at once.
GROUP_ROWS, COMPARED = 4_096, 1 << 20
#: Texts of one component in a group from which on they aren't compared with each other.
SAME_ROOT = 64
#: Shingles in all of the texts whose sets meet in one task, about.
FAMILY = 1 << 20
#: Ids of compared texts that are sent to all tasks rather than the texts be shuffled.
MOST_SENT = 500_000


def shingles(text: str | None, words_per_shingle: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words are those of the fingerprint."""
    return np.unique(shingle_hashes(text, words_per_shingle, seed).view(np.int64))


def key_of(s: np.ndarray) -> int:
    """The signed number that stands for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).astype(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Whether the hashes of each class are odd in number, as 64-bit words; the class is the middle bits of a hash.

    There are as many classes as hashes, or up to twice as many, so the bits of large sets tell as much.
    """
    classes = max(PARITY * 64, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((s >> 24) & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def lists_of(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))


def heavy_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least four texts of a sample of bounded size hold, sorted, and about how many texts hold them."""

    def make():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, 0):
                yield pa.record_batch([pa.array(np.concatenate([shingles(t.as_py(), words) for t in part.column(0)]))], names=["s"])

        return step

    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    found = map_batches(sample, make, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n >= 4")
    rows = found.orderBy(F.desc("n"), "s").limit(MOST_HEAVY).toArrow().sort_by("s")
    return np.asarray(rows.column("s")), np.asarray(rows.column("n")) * every


def text_facts(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, fp, bits, prefix, parts) of every text.

    ``key`` stands for the set of shingles, ``fp`` is the SimHash, ``prefix`` holds the
    first shingles in the common order and ``parts`` over how many tasks each is split.
    """
    heavy, holders = heavy_shingles(docs, words)
    over, under = LEAST

    def make():
        def prefix(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = len(s) + (len(s) > 0) - -(-len(s) * over // under)
            if not len(heavy) or not len(s):
                return s[:k], np.ones(k, np.int64)
            at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
            often = np.where(heavy[at] == s, holders[at], 0)
            first = np.argsort(often, kind="stable")[:k]
            return s[first], 1 + often[first] // SHARE_ROWS

        def step(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                hashes = [shingle_hashes(t.as_py(), words) for t in part.column(1)]
                sets = [np.unique(h.view(np.int64)) for h in hashes]
                firsts = [prefix(s) for s in sets]
                cols = [
                    pa.array([key_of(s) for s in sets], pa.int64()),
                    pa.array(np.fromiter(map(len, sets), np.int32, len(sets))),
                    pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)),
                    lists_of([parity(s) for s in sets]),
                    lists_of([f for f, _ in firsts]),
                    lists_of([p for _, p in firsts]),
                ]
                yield pa.record_batch([part.column(0), *cols], names=["doc_id", "key", "n", "fp", "bits", "prefix", "parts"])
            release()

        return step

    return map_batches(docs, make, "doc_id long, key long, n int, fp long, bits array<long>, prefix array<long>, parts array<long>")


def sent(ids: DataFrame) -> DataFrame:
    """A frame of few columns and one row an id, sent to all tasks if its counted rows allow it."""
    return F.broadcast(ids) if ids.count() < MOST_SENT else ids


class Verifier:
    """Checks candidate pairs of keys, first by their parity bits, then by all their shingles."""

    def __init__(self, docs: DataFrame, distinct: DataFrame, words: int):
        self.docs, self.distinct, self.words = docs, distinct, words

    def wanted(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(sent(cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())), "key", "left_semi")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` by whose whole sets all similar ones are connected.

        Texts that pairs connect go to one task, each once, and their sets are made there; a large family of them is dealt in blocks,
        and each pair of blocks that has pairs is a task's work.  So texts, not pairs, are shuffled.
        """
        member = cut(components(pairs).withColumnRenamed("node", "key"))
        texts = cut(self.distinct.select("key", "n", "doc_id").join(sent(member), "key"))
        sizes = texts.groupBy("root").agg(F.sum(F.col("n").cast("long")).alias("n"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        blocks = sizes.where(F.col("n") > FAMILY).select("root", F.ceil(F.col("n") / FAMILY).cast("int").alias("blocks"))
        texts = texts.join(blocks, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        texts = cut(texts.select("key", "doc_id", "root", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")))
        for k in "ab":
            pairs = pairs.join(texts.select(F.col("key").alias(k), F.col("block").alias(f"block_{k}"), *(["root", "blocks"] if k == "a" else [])), k)
        tasks = max(shuffle_partitions(pairs.sparkSession), -(-total // FAMILY))
        cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", F.least("block_a", "block_b"), F.greatest("block_a", "block_b")))
        pairs = cut(pairs.select(cell.alias("cell"), "a", "b"))
        rows = pairs.select("cell", F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "doc_id"), "key")
        rows = self.docs.join(sent(cut(rows)), "doc_id").select("cell", "key", "text")
        words, (over, under) = self.words, LEAST

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            sets: dict[int, np.ndarray] = {}
            for batch in left.to_batches():
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                    s = shingles(text.as_py(), words)
                    if key_of(s) == key:  # a repeated doc_id may bring other texts
                        sets[key] = s
            root = {k: k for k in sets}

            def up(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            found = []
            for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist()):
                x, y = sets[a], sets[b]
                if up(a) != up(b) and len(np.intersect1d(x, y, assume_unique=True)) * (over + under) >= over * (len(x) + len(y)):
                    root[up(a)] = up(b)
                    found.append((a, b))
            return pa.table({k: pa.array([pair[i] for pair in found], pa.int64()) for i, k in enumerate("ab")})

        met = pairs.select(F.col("cell").alias("of"), "a", "b")  # another name, as both sides come from one frame
        return rows.groupBy("cell").cogroup(met.groupBy("of")).applyInArrow(run, "a long, b long")

    def both(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        for k in "ab":
            pairs = pairs.join(rows.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("held").alias(f"held_{k}")), k)
        return pairs

    def __call__(self, pairs: DataFrame) -> DataFrame:
        if not pairs.limit(1).count():
            return pairs
        bits = self.wanted(pairs, self.distinct.select("key", "n", F.col("bits").alias("held")))
        pairs = cut(self.both(pairs, bits).where(bits_allow("a", "b")).select("a", "b"))
        if not pairs.limit(1).count():
            return pairs
        return cut(self.similar(pairs))


def folded(bits, words):
    """The parity bits of half as many classes, ``words`` 64-bit words."""
    return F.zip_with(F.slice(bits, 1, words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))


def bits_allow(x: str, y: str):
    """Whether the sets n_x and n_y, with parity bits held_x and held_y, can be similar by their sizes and bits."""
    over, under = LEAST
    n, held = ([F.col(f"{c}_{k}") for k in (x, y)] for c in ("n", "held"))
    words = F.least(*map(F.size, held))  # near sizes have as many words or twice as many
    p, q = (F.when(F.size(h) > words, folded(h, words)).otherwise(h) for h in held)
    differ = F.aggregate(F.zip_with(p, q, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, k: s + k)
    near = F.greatest(*n) * over <= F.least(*n) * under
    return F.when(near, differ * (over + under) <= (under - over) * (n[0] + n[1])).otherwise(False)


def ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def trie_pairs(distinct: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of keys: fingerprints that the trie links, and keys of one fingerprint."""
    of_fp = cut(distinct.groupBy("fp").agg(F.min("key").alias("least")))
    twins = distinct.join(of_fp, "fp").where("key <> least").select(*ordered("key", "least"))
    near = links(of_fp.select("fp"))
    for k in "ab":
        near = near.join(of_fp.select(F.col("fp").alias(k), F.col("least").alias(f"key_{k}")), k)
    return cut(twins.unionByName(near.select(*ordered("key_a", "key_b"))).distinct())


def similar_links(docs: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) of keys whose components are those of all similar pairs of ``distinct``."""
    over, under = LEAST
    verified = Verifier(docs, distinct, words)
    edges = verified(trie_pairs(distinct))
    free_shuffles(docs.sparkSession)

    def placed(rows: DataFrame, on: str) -> DataFrame:
        """``rows`` with the component so far of the key ``on``."""
        return rows.join(roots.withColumnRenamed("key", on), on, "left").withColumn(f"root_{on}", F.coalesce("root", on)).drop("root")

    def pairs_of(rows: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs that can be similar: from the first common shingle on they can have no more in common than is left of each."""
        n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
        reach = F.least(n_x - F.col(f"{x}.place"), n_y - F.col(f"{y}.place"))
        possible = rows.where((F.col(f"{x}.key") != F.col(f"{y}.key")) & (reach * (over + under) >= over * (n_x + n_y)))
        return possible.select(*ordered(f"{x}.key", f"{y}.key"))

    me = F.struct("n", "key", "place")
    leads = F.col("me.place") * (over + under) <= (under - over) * F.col("me.n")  # the place that the smaller of two texts can have
    tokens = distinct.select("key", "n", "parts", F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.select("token", F.pmod("key", F.element_at("parts", F.col("place") + 1)).cast("int").alias("part"), (F.element_at("parts", F.col("place") + 1) > 1).alias("split"), me.alias("me"))
    by = Window.partitionBy("token", "part").orderBy("me")
    near = tokens.select(
        "*",
        F.lag("me").over(by).alias("before"),
        F.lead("me.n").over(by).alias("next"),
        F.last(F.when(leads, F.col("me.n")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("least"),
    )
    near = near.withColumn("hub", F.min(F.struct("me.place", "me.n", "me.key")).over(Window.partitionBy("token", "part")))
    above = F.coalesce(F.col("least") * under >= F.col("me.n") * over, F.lit(False))
    below = F.coalesce(leads & (F.col("next") * over <= F.col("me.n") * under), F.lit(False))
    shared = written(near.where(above | below | F.col("split")).select("token", "split", "me", "before", "hub"), "shared")
    free_shuffles(docs.sparkSession)
    hubs = shared.where(F.col("split") & (F.col("hub.key") == F.col("me.key"))).select("token", "me", F.min("hub").over(Window.partitionBy("token")).alias("hub"))

    seen = None
    for found in (pairs_of(shared, "me", "hub").unionByName(pairs_of(hubs, "me", "hub")), pairs_of(shared.where("before is not null"), "me", "before")):
        roots = cut(components(edges)).withColumnRenamed("node", "key")
        new = cut(placed(placed(found.distinct(), "a"), "b").where("root_a <> root_b").select("a", "b"))
        edges = edges.unionByName(verified(new))
        seen = new if seen is None else seen.unionByName(new)
        free_shuffles(docs.sparkSession)

    roots = cut(components(edges)).withColumnRenamed("node", "key")
    held = shared.select("token", F.col("me.key").alias("key"), leads.alias("lead")).join(sent(roots), "key", "left").select("token", "key", F.coalesce("root", "key").alias("root"), "lead")
    groups = held.groupBy("token").agg(
        F.max("lead").alias("led"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("texts"), *(F.bit_xor(F.xxhash64(F.lit(k), "key", "lead")).alias(f"held_{k}") for k in range(2))
    )
    groups = groups.where("led and lo < hi").groupBy("texts", "held_0", "held_1").agg(F.min("token").alias("token"))
    met = cut(held.join(groups.select("token", "texts"), "token"))
    free_shuffles(docs.sparkSession)
    words = (F.size("bits") / 2).cast("int")
    bits = distinct.select("key", "n", F.when(F.size("bits") > PARITY, folded(F.col("bits"), words)).otherwise(F.col("bits")).alias("bits"))
    other = close_pairs(met.join(bits, "key"), GROUP_ROWS).distinct()
    return edges.unionByName(verified(cut(other.join(seen, ["a", "b"], "left_anti"))))


def close_pairs(met: DataFrame, group_rows: int) -> DataFrame:
    """Pairs (a, b) of texts of a group ``token`` that lie in different components and can be similar by sizes and bits, ``lead`` in the smaller.

    ``met`` has a row (token, texts, key, n, root, lead, bits) for each text; a group of many ``texts`` is dealt in blocks, each
    pair of which is a task's work.  A pair that several groups hold may come several times.
    """
    blocks = F.ceil(F.col("texts") / group_rows).cast("int")
    block, each = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda i, j, left, right: F.struct((i * F.col("blocks") + j).alias("cell"), left.alias("left"), right.alias("right"))
    lead = F.transform(each, lambda j: cell(F.col("block"), j, F.col("lead"), j == F.col("block")))
    others = F.filter(F.transform(each, lambda i: cell(i, F.col("block"), F.lit(False), i != F.col("block"))), lambda c: c["right"])
    rows = met.withColumn("blocks", blocks).withColumn("block", block).select("token", "key", "n", "root", "bits", F.inline(F.concat(lead, others))).where(F.col("left") | F.col("right"))
    dealt = rows.repartition(shuffle_partitions(met.sparkSession), "token", "cell").sortWithinPartitions("token", "cell")

    def compared(batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        token, key, n, root, cells = (np.asarray(table.column(c)) for c in ("token", "key", "n", "root", "cell"))
        left, right = (table.column(c).to_numpy() for c in ("left", "right"))
        bits = table.column("bits").chunk(0)
        ends, flat = np.asarray(bits.offsets), np.asarray(bits.values).view(np.uint64)
        edges = np.flatnonzero((token[1:] != token[:-1]) | (cells[1:] != cells[:-1])) + 1
        found = []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(token)]):
            if hi - lo > 1:
                found += [(lo + i, lo + j) for i, j in close_rows(*(c[lo:hi] for c in (key, n, root, left, right, ends[:-1], np.diff(ends))), flat)]
        if found:
            i, j = (np.concatenate(c) for c in zip(*found))
            both = np.unique(np.stack((np.minimum(key[i], key[j]), np.maximum(key[i], key[j]))), axis=1)
            yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        group: list[pa.RecordBatch] = []  # the last one so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("token", "cell")])
            begins = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            if group and all(group[0].column(c)[0].as_py() == x for c, x in zip(("token", "cell"), ids[:, 0])):
                begins = begins.tolist()
            else:
                begins = [0, *begins.tolist()]
            if begins:
                whole = [*group, batch.slice(0, begins[-1])]
                if sum(b.num_rows for b in whole):
                    yield from compared(whole)
                group = []
            group.append(batch.slice(begins[-1] if begins else 0))
        if group:
            yield from compared(group)

    return dealt.mapInArrow(run, "a long, b long")


def close_rows(key, n, root, left, right, start, words, flat):
    """Pairs of places (i, j), i ``left`` and the smaller, j ``right``, in different components, whose sizes and parity bits allow similarity.

    The bits of a row are its number of ``words`` of ``flat`` from ``start`` on; the products of a few rows are held at a time.
    """
    over, under = LEAST
    for w in np.unique(words[left]).tolist():
        at = np.arange(w)
        mine = np.flatnonzero(left & (words == w))
        theirs = np.flatnonzero(right & ((words == w) | (words == 2 * w)))
        theirs = theirs[np.argsort(n[theirs], kind="stable")]
        bits = flat[start[theirs, None] + at]
        wide = words[theirs] > w
        bits[wide] ^= flat[start[theirs[wide], None] + w + at]
        roots, many = np.unique(root[mine], return_counts=True)
        large = roots[many >= SAME_ROOT].tolist()
        parts = [(mine[root[mine] == r], root[theirs] != r) for r in large] + [(mine[~np.isin(root[mine], large)], slice(None))]
        for rows, of in parts:
            rows, to, held = rows[np.argsort(n[rows], kind="stable")], theirs[of], bits[of]
            step = max(1, COMPARED // max(1, w * len(to)))
            for k in range(0, len(rows), step):
                i = rows[k : k + step]
                lo, hi = np.searchsorted(n[to], (n[i[0]], n[i[-1]] * under // over + 1))
                j = to[lo:hi]
                if len(j):
                    differ = np.bitwise_count(flat[start[i, None] + at][:, None] ^ held[lo:hi]).sum(2, dtype=np.int64)
                    x, y = n[i, None].astype(np.int64), n[j].astype(np.int64)
                    good = (differ * (over + under) <= (under - over) * (x + y)) & (root[i, None] != root[j]) & ((x < y) | ((x == y) & (key[i, None] < key[j]))) & (y * over <= x * under)
                    p, q = np.nonzero(good)
                    if len(p):
                        yield i[p], j[q]


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = WORDS) -> DataFrame:
    """(doc_id, component_id) of each row with a doc_id: the smallest doc_id that links reach, itself included."""
    docs = documents_of(docs).where("doc_id is not null")
    facts = written(text_facts(docs, words_per_shingle).withColumn("row", F.monotonically_increasing_id()), "facts")
    classes = cut(facts.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.min_by("row", "doc_id").alias("row")))
    distinct = facts.where("n > 0").join(sent(classes.select("row")), "row", "left_semi")
    if classes.count() >= MOST_SENT:  # then the join is a shuffle, which is done once
        distinct = written(distinct, "distinct")
    classes = classes.drop("row")
    member = cut(components(similar_links(docs, distinct, words_per_shingle)).withColumnRenamed("node", "key"))
    least = member.join(classes, "key").groupBy("root").agg(F.min("rep").alias("least"))
    placed = classes.join(member.join(least, "root").select("key", "least"), "key", "left")
    placed = cut(placed.select("key", F.coalesce("least", "rep").alias("component_id"), "class_size"))
    return with_class(facts.select("doc_id", "key"), placed, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of similar texts: that with the smallest doc_id."""
    return keep_first(docs, near_duplicates(docs, **options))
