"""Verdicts on cases worked out by hand, and missed sentences at every place of a buzz."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import verdicts as V

SENTENCES = [
    "A governess sees two ghosts at a country house.", "Another book follows an heiress who marries badly.", "Play C–D–E–F there.", "He wrote of an envoy in Paris.", "Name this author.",
]


def units(sentence):
    return [p for w in sentence.split() for p in (w.replace("–", "–|").split("|") if "–" in w else [w])]


@pytest.mark.parametrize("read", [0, 2, 9])
def test_missed_at_every_buzz(spark, read):
    n = len(SENTENCES)
    start = n - read if 0 < read < n else 0
    skipped = sum(len(s.split()) for s in SENTENCES[:start])
    counts = [len(units(s)) for s in SENTENCES[start:]]
    total = skipped + sum(counts)
    rows, want = [], []
    for heard in range(sum(counts) + 1):
        # depth as it is kept, to three places
        rows.append((heard, SENTENCES, round((skipped + heard) / total, 3), read))
        last, seen = start, 0
        for k, c in enumerate(counts):
            if heard > seen:
                last = start + k
            seen += c
        want.append((heard, last, [last - k for k in (1, 2, 3) if last >= k] or [last]))
    rows += [(900, SENTENCES, None, read), (901, [], 0.5, read), (902, None, 0.5, read), (903, ["One only."], 0.9, read), (904, SENTENCES, 7.0, read), (905, SENTENCES, -1.0, None)]
    want += [(900, 4, [3, 2, 1]), (901, None, None), (902, None, None), (903, 0, [0]), (904, 4, [3, 2, 1]), (905, 0, [0])]
    df = spark.createDataFrame(rows, "id int, s array<string>, bf double, sent int")
    got = V.missed(df, sentences="s", depth="bf", read="sent").select("id", "last_heard", "asked").collect()
    assert sorted(map(tuple, got)) == want


def test_first_words(spark):
    cases = [
        ("Phthalic", "phthalic", True), ("", "Phthalic", False), ("They", "Phthalic", False), ("Dalek", "Phthalic", False), ("and", "An", True), ("Oiler", "Euler", True), ("robot", "Euler", False),
        ("fix", "Fick's", True), ("x", "!!", True), ("the", "on", True), ("Bee", "Tree", True), (None, "x", None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "h string, w string")
    got = [r[0] for r in df.select(V.first_word_ok(F.col("h"), F.col("w"))).collect()]
    assert got[:-1] == [c[2] for c in cases[:-1]]
    texts = spark.createDataFrame([("“The” end",), ("... 12, x",), ("?",), ("",)], "t string")
    assert [r[0] for r in texts.select(V.first_content_word(F.col("t"))).collect()] == ["the", "12", "", ""]


def test_file_names(spark):
    cases = [
        ("Vincent_van_Gogh_-_Starry.jpg", "Vincent van Gogh", "pass"), ("gogh.png", "Vincent van Gogh", "pass"), ("claude_monet_-_Lilies.jpg", "Vincent van Gogh", "fail"),
        ("Lilies_by_Monet.jpg", "Gogh", "fail"), ("IMG_2031.jpg", "Gogh", "fail"), ("Starry_Night.jpg", "Gogh", "pending"), ("Van.jpg", "van", "pass"), ("the.jpg", "The Who", "pending"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "f string, a string")
    assert [r[0] for r in df.select(V.filename_verdict(F.col("f"), F.col("a"))).collect()] == [c[2] for c in cases]


def test_instructions(spark):
    cases = [
        ("Note to players: two answers required.", True), ("  Answer the following about Bees", True), ("The composer and genre are required", True), ("We note to players nothing", False),
        ("Name the bee. " + "x" * 120, False), ("composer and type " + "y" * 25 + "required", False), ("", False),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r[0] for r in df.select(V.is_boilerplate(F.col("t"))).collect()] == [c[1] for c in cases]


def test_votes(spark):
    votes = [(1, "a", 2.0), (1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 2.5), (3, "a", 2.9), (4, "b", 4.0), (5, "b", 3.0), (5, "a", 3.0)]
    df = spark.createDataFrame(votes, "k int, section string, w double")
    assert sorted(map(tuple, V.voted(df, key="k", choice="section", weight="w").collect())) == [(1, "a", 3.0), (4, "b", 4.0)]
    loose = V.voted(df, key="k", choice="section", weight="w", least=0.0, margin=1.0).collect()
    assert {r.k: r.section for r in loose} == {1: "a", 2: "a", 3: "a", 4: "b", 5: "a"}
