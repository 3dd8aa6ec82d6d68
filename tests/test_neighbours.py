"""Neighbours within a group, against all pairs."""

import random

from corpusloom.plans.curation import nearest_of_group


def test_nearest_balances_without_all_pairs(spark):
    rng = random.Random(5)
    rows = [(n % 3, n, rng.choice([None, float("nan"), 1.0, 1.0, 1.5, 2.0, rng.randrange(900) / 100])) for n in range(400)]
    df = spark.createDataFrame(rows, "s_nationkey long, id long, x double")
    want = set()
    for g, a, x in rows:
        far = lambda y: (2, 0) if x is None or y is None else (1, 0) if x != x or y != y else (0, abs(x - y))  # noqa: B023, E731
        others = sorted((far(y), b) for h, b, y in rows if h == g and b != a)
        want |= {(a, b, k + 1) for k, (_, b) in enumerate(others[:5])}
    found = nearest_of_group(df, 5)
    assert {tuple(r) for r in found.select("a", "b", "rank").collect()} == want
    joins = found._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == 2  # rows meet the lists of their value and of their group, not each other


def test_nearest_codes_of_a_key_by_blocks(spark, monkeypatch):
    from corpusloom.operators import vector

    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), n, [rng.getrandbits(6), rng.getrandbits(4)]) for n in range(500)]
    df = spark.createDataFrame(rows, "label int, vec_id long, code array<long>")
    asks = df.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "code as q", "label")
    sent = spark.sparkContext.accumulator(0)
    real = vector.gridded

    def small(left, right, run, *args, **options):
        def counted(key, left, right):
            out = run(key, left, right)
            sent.add(out.num_rows)
            return out

        return real(left, right, counted, *args, **options, rows=100)

    monkeypatch.setattr(vector, "gridded", small)
    got = {tuple(r) for r in vector.nearest_codes(df, asks, 7, key="label").collect()}
    want = set()
    for g, q, code in rows[::10]:
        if g is not None:
            far = sorted((sum((x ^ y).bit_count() for x, y in zip(code, c)), i) for h, i, c in rows if h == g and i != q)
            want |= {(q, i, bits) for bits, i in far[:7]}
    assert got == want
    assert sent.value <= 50 * 7 * 4  # a block sends a query's nearest, not all its rows


def test_exact_search_sends_few_rows_of_many_equal_ones(spark, monkeypatch):
    from corpusloom.operators import vector

    rng = random.Random(7)
    some = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(3)]
    df = spark.createDataFrame([(n, some[n % 3]) for n in range(600)], "vec_id long, embedding array<double>")
    sent = spark.sparkContext.accumulator(0)
    real = vector.gridded

    def counting(left, right, run, *args, **options):
        def counted(key, left, right):
            out = run(key, left, right)
            sent.add(out.num_rows)
            return out

        return real(left, right, counted, *args, **options)

    monkeypatch.setattr(vector, "gridded", counting)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.exact(df, df.where("vec_id % 50 = 0"), 4).collect()}
    for q in range(0, 600, 50):
        equal = [n for n in range(600) if n % 3 == q % 3 and n != q]
        assert [got[q, r] for r in range(1, 5)] == equal[:4]
    assert sent.value <= 12 * 4  # before: every equal row


def test_scores_are_rounded_as_spark_does(spark):
    from corpusloom.operators import vector

    values = [0.1234565, -0.1234565, 0.1234575, 1.0, -1.0, 0.0, 0.0000005, 0.9999995, 0.99999949999999] + [random.Random(8).uniform(-1, 1) for _ in range(50)]
    want = [round(r[0] * 1e6) for r in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 6)").collect()]
    assert vector.millionths(vector.np.array(values)).tolist() == want
