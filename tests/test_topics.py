"""Topic operators on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import topics as O


def test_highlight_stays_out_of_tags(spark):
    cases = [
        ("The <b title='ode'>Ode</b> to an ode", "ode", "The <b title='ode'><mark>Ode</mark></b> to an <mark>ode</mark>"),
        ("a.b axb", "a.b", "<mark>a.b</mark> axb"), ("C:\\E and $1", "\\e", "C:<mark>\\E</mark> and $1"), ("x", "", "x"), ("x", None, "x"), (None, "x", None),
        ("Été ÉTÉ", "été", "<mark>Été</mark> <mark>ÉTÉ</mark>"), ("(a) [b] (a", "(a", "<mark>(a</mark>) [b] <mark>(a</mark>"), ("x", "y", "x"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "text string, query string")
    assert [r[0] for r in df.select(O.highlighted(F.col("text"), F.col("query"))).collect()] == [c[2] for c in cases]


def test_labels_of_tabs(spark):
    cases = [("Bee", [7, 10, 8], True, "Bee (d7–10) mentions"), ("Bee", [9], False, "Bee (d9–9)"), ("Bee", [], None, "Bee"), (None, None, None, "?")]
    df = spark.createDataFrame([c[:3] for c in cases], "q string, d array<int>, m boolean")
    assert [r[0] for r in df.select(O.tab_label(F.col("q"), F.col("d"), F.col("m"))).collect()] == [c[3] for c in cases]


def test_real_works_and_places(spark):
    names = ["General Style", "Odes", "Biographical notes", "Other Works", "Others", "In general", None, "Mother Courage", "Another Life"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    # a fragment counts wherever it stands and as it is written
    assert [r[0] for r in df.select(O.is_real_work(F.col("n"))).collect()] == [False, True, False, False, True, True, True, True, True]
    places = spark.createDataFrame([("Hague",), ("The Gambia",), (None,), ("Hague",)], "place string")
    got = O.is_place(spark.createDataFrame([("The Hague",), ("Hague",), ("Gambia",), ("The Gambia",), (None,), ("hague",)], "n string"), "n", places, "place").collect()
    assert {r.n: r.is_place for r in got} == {"The Hague": True, "Hague": True, "Gambia": False, "The Gambia": True, None: False, "hague": False} and len(got) == 6


def test_reviews_and_names(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, flag boolean")
    shown = {m: [r.id for r in df.where(O.in_review(F.col("flag"), m)).orderBy("id").collect()] for m in O.MODES}
    assert shown == {"all": [1, 2, 3], "review": [1], "ok": [2, 3]}
    with pytest.raises(KeyError):
        O.in_review(F.col("flag"), "some")
    names = spark.createDataFrame([("ACF Nationals",), ("acf%fall",), (None,)], "n string")
    assert [r.n for r in names.where(O.name_holds(F.col("n"), "F N")).collect()] == ["ACF Nationals"]
    assert [r.n for r in names.where(O.name_holds(F.col("n"), "%")).collect()] == ["acf%fall"]


def test_entries_before_their_works(spark):
    schema = "unit string, sections array<struct<name: string, entries: array<struct<answerline: string, variants: array<string>, works: array<struct<answerline: string, variants: array<string>>>>>>>"
    rows = [("u", [("one", [("A", ["a"], [("A1", None), ("A2", ["x"])]), ("B", None, None)]), ("none", []), ("two", [("C", [], [])])]), ("v", None)]
    got = O.placed_entries(spark.createDataFrame(rows, schema), "unit").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        ("u", "one", 0, 0, "A", ["a"]), ("u", "one", 1, 1, "A1", None), ("u", "one", 2, 1, "A2", ["x"]), ("u", "one", 3, 0, "B", None), ("u", "two", 4, 0, "C", []),
    ]


def test_packets_in_order_with_default_values(spark):
    rows = [(1, 2, "tossup", "second", None, None), (1, 1, "tossup", "first", None, None), (1, 9, "bonus", "lead", ["a", "b"], "[5, 15]"), (1, 3, "bonus", "early", ["c"], None), (1, 4, "bonus", "odd", [], "[5")]
    df = spark.createDataFrame(rows, "p int, n int, kind string, text string, parts array<string>, worth string")
    (r,) = O.packets(df, packet="p", number="n", kind="kind", text="text", parts="parts", values="worth").collect()
    assert [t.question for t in r.tossups] == ["first", "second"]
    assert [(b.leadin, b["values"]) for b in r.bonuses] == [("early", [10, 10, 10]), ("odd", [10, 10, 10]), ("lead", [5, 15])]


def test_queues(spark):
    first = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "topic string, category string")
    got = {(r.queue, r.category): r.n for r in O.queue_summary({"first": first, "second": first.limit(0)}, "category").collect()}
    assert got == {("first", "x"): 2, ("first", "Unknown"): 1, ("first", None): 3}
    rows = [("A", "x", 1, 50), ("d", "y", 2, 15), ("D", "z", 1, 99), ("e", "y", 3, 20), ("f", "y", 3, 19), ("g", "y", 4, 99), ("h", "y", 2, 14)]
    candidates = spark.createDataFrame(rows, "topic string, category string, works int, questions int")
    out = O.enqueued(first, candidates, order=[F.col("questions")]).collect()
    new = {r.topic: (r.tier, r.reason, r.difficulties, r.min_year) for r in out if r.reason}
    assert new == {
        "d": ("definite", "redo: 2 works from 15 questions (tier=definite)", "7,8,9,10", 2012),
        "e": ("likely", "redo: 3 works from 20 questions (tier=likely)", "7,8,9,10", 2012),
    } and len(out) == 5
    assert {r.topic for r in O.enqueued(first, candidates, order=[F.col("questions")], tiers=("maybe",)).collect()} == {"a", "b", "c", "f", "g", "h"}


def test_breakdowns_take_names(spark):
    log = spark.createDataFrame([("x", "", 1), ("x", "b", 2), (None, "b", 3), ("y", "b", 5)], "p string, q string, v int")
    table = O.Breakdown({"p": F.col("p"), "q": F.col("q"), "big": F.col("v") > 2}, {"n": F.count("*"), "v": F.sum("v")})
    assert sorted(map(tuple, table(log, ["q", "p"], ["v"]).collect())) == [("x", "b", 2), ("y", "b", 5)]
    assert table(log, ["q", "p"], ["v"]).columns == ["p", "q", "v"] and table(log, [], ["n"]).first().n == 4
    more = table.with_(dimensions={"odd": F.col("v") % 2}, metrics={"most": F.max("v")})
    assert sorted(map(tuple, more(log, ["odd"], ["most", "n"]).collect())) == [(0, 2, 1), (1, 5, 3)]
    for by, show in ((["nothing"], ["n"]), (["p"], ["nothing"]), (["p"], [])):
        with pytest.raises(ValueError):
            table(log, by, show)
