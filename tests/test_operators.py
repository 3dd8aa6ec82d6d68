"""Operators without a SQL oracle, against brute force on small tables."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ann, cluster, match, vector


def linked(x, cut):
    """Average linkage by its definition: the mean of all cosines between two groups."""
    groups = [[k] for k in range(len(x))]
    sim = x @ x.T
    while len(groups) > 1:
        best, a, b = max((float(np.mean([sim[i, j] for i in g for j in h])), -a, -b) for a, g in enumerate(groups) for b, h in enumerate(groups) if a < b)
        if best < cut:
            break
        groups[-a] += groups.pop(-b)
    return {min(g): sorted(g) for g in groups}


@pytest.mark.parametrize("local", [4, 1000])
def test_themes_of_whole_keys(spark, local):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for key, n in (("a", 26), ("b", 14), ("c", 3)):
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, n)] + 0.35 * rng.normal(size=(n, 6))
        ids = [len(rows) + k for k in range(n)]
        rows += [(key, i, v.tolist()) for i, v in zip(ids, x)]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for group in linked(unit, 1 - 0.3).values() if n >= 4 else [list(range(n))]:
            parts = linked(unit[group], 1 - 0.1).values() if len(group) > 8 else [range(len(group))]
            for p in parts:
                own = [ids[group[k]] for k in p]
                want |= {i: min(own) if len(own) > 1 else -1 for i in own}
    df = spark.createDataFrame([*rows, ("a", None, [1.0] * 6), ("b", 900, None)], "key string, id long, v array<double>")
    got = cluster.theme_clusters(df, key="key", id_col="id", vec_col="v", distance=0.3, finer=0.1, local=local)
    assert {r["id"]: r["theme"] for r in got.collect()} == want
    assert cluster.theme_clusters(df.limit(0), key="key", id_col="id", vec_col="v").count() == 0


def test_ratio_pairs_miss_none(spark):
    rnd = random.Random(5)
    names = {"a", "ab", "abc", "zz", "aaaaaaaaaaaa", "aaaaaaaaaaab"}
    for _ in range(60):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(2, 40))).strip() or "q"
        names.add(base)
        for _ in range(3):
            chars = list(base)
            for _ in range(rnd.randint(0, 6)):
                chars[rnd.randrange(len(chars)) : rnd.randrange(len(chars)) + rnd.randint(0, 1)] = rnd.choice(["x", "", "ab"])
                chars = chars or ["q"]
            names.add("".join(chars) or "q")
    df = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r["key"], r["near"]): r["ratio"] for r in match.ratio_pairs(df, df).collect()}
    want = {(a, b): r for a in names for b in names if a != b and (r := SequenceMatcher(None, a, b).ratio()) >= 0.82}
    assert got == pytest.approx(want)
    assert any(sum(map(len, p)) > 50 and len(p[0]) == len(p[1]) for p in want)  # long names with many edits


def test_greedy_clusters_grow_by_words_of_the_whole_group():
    rows = [["ode", "joy", "ninth"], ["ode", "joy", "choral"], ["choral", "finale", "joy"], ["tuba", "solo"]]
    often = {"ode": 2, "joy": 3, "ninth": 1, "choral": 2, "finale": 1, "tuba": 1, "solo": 1}
    weight = {w: 1 / (1 + 10 * n / 4) for w, n in often.items()}
    assert cluster.greedy_clusters(rows, weight, often) == [0, 0, 0, 1]
    # "choral" joins the set because two rows of the group hold it, so the third row shares two words
    assert cluster.greedy_clusters(rows, weight, {**often, "choral": 1}) == [0, 0, 1, 2]


def test_calibration_by_sums_is_the_fit_of_each_key(spark):
    rng = np.random.default_rng(4)
    rows = [(k, round(float(x), 1 if k else 6), float(rng.random() < 1 / (1 + np.exp(-(k - 1) * x)))) for k in range(3) for x in rng.normal(size=120)]
    rows += [(7, 0.5, 1.0), (8, None, 1.0), (8, 0.1, None)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {r.k: r for r in cluster.calibration(df, key="k", x_col="x", y_col="y").collect()}
    assert set(got) == {0, 1, 2, 7}
    for k, r in got.items():
        own = [(x, y) for q, x, y in rows if q == k]
        a, b = cluster.logistic_1d(*map(np.array, zip(*own)))
        assert r.n == len(own) and abs(r.intercept - a) < 1e-6 and abs(r.slope - b) < 1e-6
    assert cluster.calibration(df.limit(0), key="k", x_col="x", y_col="y").count() == 0


@pytest.mark.parametrize("binary", [True, False])
def test_strength_against_a_plain_fit(spark, binary):
    rng = np.random.default_rng(11)
    n = 900
    g = rng.choice(["arts", "history", "music", "small"], n, p=[0.4, 0.35, 0.235, 0.015])
    lv = rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-(np.select([g == "arts", g == "music"], [0.9, -0.8], 0.0) - 0.7 * lv)))
    y = (rng.random(n) < p).astype(float) if binary else p * 15 + rng.normal(size=n)
    df = spark.createDataFrame([(str(a), int(b), float(c), k, n) for k, (a, b, c) in enumerate(zip(g, lv, y))], "g string, lv int, y double, place long, rows long")
    got = {r["g"]: r for r in cluster.strength(df, group="g", level="lv", y="y", place="place", rows="rows", binary=binary).collect()}
    names = ["arts", "history", "music", "pool"]
    of = np.array([names.index(a) if a in names else 3 for a in g])
    t = np.arange(n) / (n - 1) - 0.5
    effect = np.where((of == 3)[:, None], -1.0, np.eye(3)[np.minimum(of, 2)])
    x = np.column_stack([np.ones(n), t, t * t - 1 / 12, lv == 1, lv == 2, effect])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta)) if binary else x @ beta
        w = np.maximum(mu * (1 - mu), 1e-6) if binary else np.ones(n)
        h = x.T @ (x * w[:, None]) + 1e-3 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (y - mu)) if binary else np.linalg.solve(h, x.T @ y)
    gamma = np.append(beta[5:], -beta[5:].sum())
    share = np.bincount(of, minlength=4) / n
    mean = float(share @ gamma)
    eta = x[:, :5] @ beta[:5] + mean
    assert set(got) == {"arts", "history", "music"}
    for k, name in enumerate(names[:3]):
        shifted = eta + gamma[k] - mean
        want = np.mean(1 / (1 + np.exp(-shifted))) - np.mean(1 / (1 + np.exp(-eta))) if binary else gamma[k] - mean
        assert abs(got[name]["est"] - want) < (1e-6 if binary else 1e-3) and got[name]["se"] > 0 and got[name]["n"] == int((of == k).sum())
    assert got["arts"]["est"] > got["history"]["est"] > got["music"]["est"]
    assert cluster.strength(df.limit(50), group="g", level="lv", y="y", place="place", rows="rows").count() == 0


@pytest.mark.parametrize("binary", [True, False])
def test_strength_with_many_levels(spark, binary):
    """Levels that are eliminated by their sums give what a column for each gives."""
    rng = np.random.default_rng(3)
    n, levels = 6_000, 1_200
    lv = rng.integers(0, levels, n)
    g = np.where(rng.random(n) < 0.3 + 0.4 * (lv % 2), "a", np.where(rng.random(n) < 0.5, "b", "c"))
    p = 1 / (1 + np.exp(-(np.where(g == "a", 0.8, -0.3) + rng.normal(size=levels)[lv])))
    y = (rng.random(n) < p).astype(float) if binary else 10 * p + rng.normal(size=n)
    df = spark.createDataFrame([(str(a), f"{b:05d}", float(c), k, n) for k, (a, b, c) in enumerate(zip(g, lv, y))], "g string, lv string, y double, place long, rows long")
    got = {r["g"]: r for r in cluster.strength(df, group="g", level="lv", y="y", place="place", rows="rows", binary=binary).collect()}
    t = np.arange(n) / (n - 1) - 0.5
    effect = np.select([(g == "a")[:, None], (g == "b")[:, None]], [[1.0, 0.0], [0.0, 1.0]], -1.0)
    x = np.column_stack([np.ones(n), t, t * t - 1 / 12, np.eye(levels)[lv][:, 1:], effect])
    beta = np.zeros(x.shape[1])
    for _ in range(40 if binary else 1):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500))) if binary else np.zeros(n)
        w = np.maximum(mu * (1 - mu), 1e-6) if binary else np.ones(n)
        h = x.T @ (x * w[:, None]) + 1e-3 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (y - mu))
    gamma = np.append(beta[-2:], -beta[-2:].sum())
    share = np.array([(g == k).mean() for k in "abc"])
    mean = float(share @ gamma)
    eta = x[:, :-2] @ beta[:-2] + mean
    plain = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    for k, name in enumerate("abc"):
        want = np.mean(1 / (1 + np.exp(-np.clip(eta + gamma[k] - mean, -500, 500)))) - plain.mean() if binary else gamma[k] - mean
        assert abs(got[name]["est"] - want) < 1e-4 and got[name]["se"] > 0


def test_linkage_of_a_large_key_compares_few_pairs(spark):
    rng = np.random.default_rng(12)
    n, dims = 2_500, 24
    x = rng.normal(size=(120, dims))[rng.integers(0, 120, n)] + 0.15 * rng.normal(size=(n, dims))
    x[:40] = x[0]  # equal rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(x)], "key string, id long, unit array<double>").repartition(8)
    compared = spark.sparkContext.accumulator(0)
    got = {r.id: r.cluster for r in cluster.linkage(df, 0.75, local=1_000, compared=compared).collect()}
    label = cluster.average_linkage(x[:600], np.ones(600), 0.75)
    # the whole by its definition: every cluster is far from all others, and no merge within was below the cut
    of = np.array([got[i] for i in range(n)])
    names, place = np.unique(of, return_inverse=True)
    total = np.zeros((len(names), dims))
    np.add.at(total, place, x)
    size = np.bincount(place)
    mean = total / size[:, None]
    between = mean @ mean.T
    np.fill_diagonal(between, -1)
    assert between.max() < 0.75 and (np.sort(names) == np.unique([of[place == k].min() for k in range(len(names))])).all()
    assert len(set(zip(label.tolist(), of[:600].tolist()))) == len(set(of[:600].tolist())) == len(set(label.tolist()))
    assert len(set(of[:40])) == 1
    # all rounds together compare less than a tenth of the pairs of one round
    assert 0 < compared.value < 0.1 * n * n


def clustered(spark, n, groups, dims=64, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, dims))
    df = spark.createDataFrame([(k, v.tolist(), int(k % 3)) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    return x, df


def test_search_chain_finds_what_is_near(spark):
    x, df = clustered(spark, 800, 40)
    ivf = ann.train(df)
    asks = df.where("vec_id % 100 = 0")
    found = ann.search(ann.index(df, ivf), ann.asked(asks, ivf), ivf).collect()
    exact = vector.exact(df, asks, 10).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 800, 100):
        best = [k for k in np.lexsort((np.arange(800), -np.round(unit @ unit[q], 6))).tolist() if k != q][:10]
        assert [r["vec_id"] for r in sorted(exact, key=lambda r: r["rank"]) if r["query_id"] == q] == best
        assert len(set(best) & {r["vec_id"] for r in found if r["query_id"] == q}) >= 8
        assert all(abs(r["score"] - unit[q] @ unit[r["vec_id"]]) < 0.03 for r in found if r["query_id"] == q)


def test_recall_of_the_given_vectors(spark):
    """Whole chain over 0.9 on the given vectors, which lie far apart, stage by stage as in plain search."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asks = given.where("vec_id % 100 = 0")
    ivf = ann.train(given)
    got = {r.query_id: r for r in ann.stage_recalls(given, asks, ivf).collect()}
    rows = given.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    ids, x = np.array([r.vec_id for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)
    part, codes = ivf.assign(x), ivf.codes(x)
    for q, r in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        sims = np.round(x @ x[at], 6)
        sims[at] = -np.inf
        best = set(ids[np.lexsort((ids, -sims))[:10]].tolist())
        seen = np.flatnonzero(np.isin(part, ivf.nearest_parts(x[at][None], ivf.probes)[0]) & (ids != q))
        bits = np.bitwise_count(codes[seen] ^ codes[at]).sum(1)
        near = seen[np.lexsort((ids[seen], bits))[: ivf.candidates]]
        assert abs(r.partitions - len(best & set(ids[seen].tolist())) / 10) < 1e-9 and abs(r.hamming - len(best & set(ids[near].tolist())) / 10) < 1e-9
        assert r.chain <= r.hamming <= r.partitions and abs(r.rows_read - len(seen) / len(ids)) < 1e-9
    assert len(got) == 20 and np.mean([r.chain for r in got.values()]) >= 0.9


def test_clustered_vectors_need_few_partitions(spark):
    x, df = clustered(spark, 20_000, 200, dims=32)
    ivf = ann.train(df)
    got = ann.stage_recalls(df, df.where("vec_id % 400 = 0"), ivf).collect()
    assert abs(ivf.parts - 141) < 3 and len(got) == 50
    assert np.mean([r.chain for r in got]) >= 0.9 and np.mean([r.rows_read for r in got]) < 0.05
    assert ivf.candidates < 0.05 * 20_000 and ivf.curve == sorted(ivf.curve)
    # a row meets the top level and a few groups, not all centroids
    assert len(ivf.top) + ann.LOOK * np.diff(ivf.group).max() < ivf.parts


def test_written_index_is_read_by_partition(spark, tmp_path):
    x, df = clustered(spark, 2_000, 20)
    ivf = ann.train(df)
    idx, path = ann.index(df, ivf, carry=("label",)), str(tmp_path / "index")
    ann.write_index(idx, path)
    part = ann.read_index(spark, path, [1, 3], F.col("vec_id") < 900)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "LessThan(vec_id,900)" in plan
    assert sorted(r["vec_id"] for r in part.collect()) == sorted(r["vec_id"] for r in idx.where("part in (1, 3) and vec_id < 900").collect())
    asks = df.where("vec_id in (0, 700)")
    found = ann.search_index(spark, path, asks, ivf, where=F.col("label") == 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 700):
        best = [k for k in np.argsort(-(unit @ unit[q])).tolist() if k != q and k % 3 == 1][:10]
        assert len(set(best) & {r["vec_id"] for r in found.collect() if r["query_id"] == q}) >= 8


def test_search_ranks_in_its_blocks(spark, monkeypatch):
    """Ties at the last candidate go by id over all blocks, and of a block only a query's best leave the task."""
    x, df = clustered(spark, 1_000, 10, dims=8)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    ivf = ann.train(df)
    idx, probe = ann.index(df, ivf), ann.asked(df.where("vec_id % 50 = 0"), ivf, probes=max(1, ivf.parts // 2))
    rows, asks = idx.orderBy("vec_id").collect(), probe.collect()
    code = np.array([r.code for r in rows]).view(np.uint64)
    grid = ann.Grid(idx, probe, "vec_id")
    assert len(grid.edges) > 3
    for candidates in (7, 90, 5_000):
        got = {(r.query_id, r.vec_id): (r["rank"], r.score, r.h) for r in ann.search(idx, probe, ivf, candidates=candidates).collect()}
        want = {}
        for q in asks:
            base = dict(zip(q.parts, q.bases))
            h = np.bitwise_count(code ^ np.array(q.q_code).view(np.uint64)).sum(1)
            near = sorted((int(h[k]), r.vec_id, k) for k, r in enumerate(rows) if r.part in base and r.vec_id != q.query_id)[:candidates]
            scored = sorted((-(base[rows[k].part] + rows[k].scale * np.dot(rows[k].codes, q.q)), i, n) for n, i, k in near)[:10]
            want |= {(q.query_id, i): (at + 1, -s, n) for at, (s, i, n) in enumerate(scored)}
        assert got.keys() == want.keys()
        assert all(got[k][2] == want[k][2] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert ann.shortlisted(grid, probe, ann.cuts(grid, probe, 500), 10).count() <= len(asks) * (len(grid.edges) + 1) * 10


def test_index_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [0.0, 2.0]), (6, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ivf = ann.train(df.where("vec_id < 6"))
    assert sorted(r.vec_id for r in ann.index(df, ivf).collect()) == [1, 1, 5]
    found = ann.search(ann.index(df, ivf), ann.asked(df.where("vec_id = 5"), ivf), ivf).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [1, 1]
    with pytest.raises(ValueError, match="no vectors"):
        ann.train(df.limit(0))


def test_linker_rules():
    lex = {"Anna Akhmatova": [("aa", "auto")], "Akhmatova": [("aa", "gated")], "Carmen": [("ca", "auto")], "Miller": [("am", "gated"), ("hm", "gated")], "Ode": [("ode", "auto")], "Augustus": [("au", "auto")]}
    text = "Anna Akhmatova wrote, and later Akhmatova met Carmen Maria Machado, and Carmen sang. The Miller said ode\nOde, and Augustus."
    got = match.linked(text, lex, own=None, own_name="Augustus Saint-Gaudens")
    assert [(t, s, tier) for t, s, _, tier, _ in got] == [("aa", "Anna Akhmatova", "auto"), ("aa", "Akhmatova", "gated"), ("am", "Miller", "gated"), ("hm", "Miller", "gated"), ("ode", "Ode", "auto")]
    assert got[-1][2] == text.index("Ode") and "The Miller said" in got[2][4]
    assert [t for t, *_ in match.linked("By Miller, ode.", lex, own="am", own_name=None)] == ["hm"]


def test_links_of_a_lexicon(spark):
    rnd = random.Random(3)
    words = "The the red Red house of Paul and Anna Ünal sea sea-wall 1984".split()
    texts = [(k, " ".join(rnd.choice(words) for _ in range(30))) for k in range(40)] + [(99, None)]
    lexicon = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))), f"t{k % 9}", rnd.choice(["auto", "gated"])) for k in range(25)] + [("!!", "x", "auto"), (None, "y", "auto")]
    df, lex = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(lexicon, "surface string, target string, tier string")
    got = sorted(tuple(r)[:5] for r in match.link_mentions(df, lex).collect())
    surfaces = {}
    for s, t, tier in set(lexicon[:-2]):
        surfaces.setdefault(s, []).append((t, tier))
    want = sorted((i, *x[:4]) for i, t in texts if t for x in match.linked(t, {k: sorted(v) for k, v in surfaces.items()}, None, None))
    assert got == want and got


def test_surfaces_are_found_without_patterns_as_patterns_find_them(monkeypatch):
    import random
    import re

    rng = random.Random(4)
    for _ in range(20_000):
        text, surface = ("".join(rng.choices("aé_ .-1²", k=rng.randrange(low, 14))) for low in (0, 1))
        surface = surface[: rng.randrange(1, 4)]
        assert match.whole_words(text, surface) == [m.start() for m in re.finditer(r"\b" + re.escape(surface) + r"\b", text)], (text, surface)
    # no pattern is compiled for each surface of each text
    monkeypatch.setattr(match.re, "compile", None)
    names = {f"Name{k} x": [(str(k), "auto")] for k in range(600)}
    assert [x[:3] for x in match.linked("a Name7 x, Name7 x", names, None, None)] == [("7", "Name7 x", 2)]
