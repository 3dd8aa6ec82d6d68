"""Scalar functions, greedy clustering, fits, sources and sinks on small cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from corpusloom.functions import answers, speech, text
from corpusloom.operators import cluster, match, ordered
from corpusloom.sources import tables


@pytest.mark.parametrize(
    "name, key", [("The Crème Brûlée!", "creme brulee"), ("Søren Ærø", "soren aero"), ("a cat", "cat"), ("Theory", "theory"), ("", ""), (None, None)]
)
def test_match_key(name, key):
    assert text.match_key(name) == key


def test_drill_key_has_no_transliteration():
    assert text.drill_key("Søren's Móvil") == "s ren s movil"


def test_sentences():
    assert text.sentences("Dr. Smith met J. Doe. They left! ok then. Fin") == ["Dr. Smith met J. Doe.", "They left! ok then.", "Fin"]
    assert text.sentences("") == [] == text.sentences(None)


@pytest.mark.parametrize(
    "line, given, directive",
    [
        ("<b><u>George Washington</u></b> [accept Washington]", "washingtn", "accept"),
        ("<u>Napoleon III</u> [do not accept Napoleon]", "Napoleon", "reject"),
        ("World War II", "ww2", "accept"),
        ("<u>carbon</u>", "c", "accept"),
        ("<u>tea</u> [prompt on drink by asking \"which?\"]", "drink", "prompt"),
        ("<u>x-ray</u>", "xray", "accept"),
        ("<u>seven</u>", "7", "accept"),
        ("<u>x</u>", "", "reject"),
        (None, "a", "reject"),
    ],
)
def test_judge(line, given, directive):
    assert answers.judge(line, given)[0] == directive


def test_prompt_text():
    assert answers.judge('<u>tea</u> [prompt on drink by asking "which?"]', "drink")[1] == "which?"


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=200, deadline=None)
def test_osa_is_a_bounded_symmetric_distance(a, b):
    assert answers.osa(a, b) == answers.osa(b, a) <= max(len(a), len(b))
    assert (answers.osa(a, b) == 0) == (a == b)
    assert speech.near(a, b) == (plain_distance(a, b) <= 1)


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize(
    "src, want",
    [
        ("Grignard (green-YARR) reagent", "Grignard reagent"),
        ("SUR [sir] and hat[ing] it", "SUR and hating it"),
        ("Was [one of these people]", "Was one of these people"),
        ("(II) and (1710)", "(II) and (1710)"),
        ("Mrs. D / Mr. E", "Missus D Mister E"),
        ("x [Note to moderator: slow.] y", "x y"),
        ("x [read slowly] y (Emphasized) z", "x y z"),
        ("x (editor's note: see below) y [end read] z (read carefully)", "x y z"),
        (None, ""),
    ],
)
def test_spoken(src, want):
    assert speech.spoken(src) == want


def test_greedy_clusters_keep_order_and_need_two_words():
    rows = [["a", "b"], ["a", "b", "c"], ["x"], ["a"], ["b", "c", "d"]]
    weight = dict.fromkeys("abcdx", 1.0)
    assert cluster.greedy_clusters(rows, weight, {"a": 3, "b": 3, "c": 2, "d": 1, "x": 1}) == [0, 0, 1, 2, 0]
    assert cluster.greedy_clusters(rows, weight, {"a": 3, "b": 3, "c": 1, "d": 1, "x": 1}) == [0, 0, 1, 2, 3]


def test_logistic_fit_finds_the_sign():
    x = np.linspace(-2, 2, 200)
    assert cluster.logistic_1d(x, (x > 0.1).astype(float))[1] > 1


def test_tiers(spark):
    rows = spark.createDataFrame([("k1", "c"), ("k2", "c"), ("k3", "c"), ("k4", "d"), ("k5", None)], "key string, category string")
    over = spark.createDataFrame([("k1", None)], "key string, slug string")
    exact = spark.createDataFrame([("k2", "two")], "key string, slug string")
    alias = spark.createDataFrame([("k3", "three", "c"), ("k4", "four", "c"), ("k5", "five", "c")], "key string, slug string, category string")
    got = {r["key"]: (r["slug"], r["status"]) for r in match.tiered(rows, over, exact, alias).collect()}
    assert got == {"k1": (None, "override"), "k2": ("two", "exact"), "k3": ("three", "alias"), "k4": (None, "unmatched"), "k5": ("five", "alias")}


def test_longer_surfaces_mask_shorter_ones(spark):
    texts = spark.createDataFrame([(1, "the New York Times said york"), (2, "")], "doc_id long, text string")
    lex = spark.createDataFrame([("New York Times", "nyt"), ("New York", "ny"), ("york", "y")], "surface string, target string")
    assert {(r["doc_id"], r["target"], r["position"]) for r in match.link_mentions(texts, lex).collect()} == {(1, "nyt", 4), (1, "y", 24)}


def test_fuzzy_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcde"), rng.integers(3, 9))) for _ in range(80)})
    df = spark.createDataFrame([(w,) for w in words], "key string")
    got = {(r["key"], r["near"]) for r in match.fuzzy_pairs(df, df, 2).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and plain_distance(a, b) <= 2}


def test_as_of_takes_the_last_mark(spark):
    p = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "k string, t long, id long")
    m = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b")], "k string, mt long, x string")
    assert {(r["id"], r["x"]) for r in ordered.as_of(p, m, key="k", at="t", mark_at="mt", value="x").collect()} == {(1, "b"), (2, None), (3, None)}


def test_tolerant_json_reports_bad_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1, "b": "x"}')
    (tmp_path / "bad.json").write_text('{"a": ')
    good, bad = tables.tolerant_json(spark, str(tmp_path), StructType().add("a", LongType()).add("b", StringType()))
    assert [(r["slug"], r["a"]) for r in good.collect()] == [("good", 1)]
    assert [r["slug"] for r in bad.collect()] == ["bad"]


def test_write_changed_writes_only_what_differs(spark, tmp_path):
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, v string").withColumn("digest", tables.content_hash(F.col("v")))
    old = spark.createDataFrame([(1, "x"), (2, "q")], "id long, v string").withColumn("digest", tables.content_hash(F.col("v")))
    tables.write_changed(new, old, "id", str(tmp_path / "out"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_a_word_of_a_longer_name_is_no_link(spark):
    texts = spark.createDataFrame([(1, "Mozart met Haydn Variations fans"), (2, "The Haydn of it")], "doc_id long, text string")
    lex = spark.createDataFrame([("Haydn", "h")], "surface string, target string")
    assert {r["doc_id"] for r in match.link_mentions(texts, lex).collect()} == {2}
    assert {r["doc_id"] for r in match.link_mentions(texts, lex, guard=False).collect()} == {1, 2}


def test_outline_errors(spark):
    from corpusloom.sources.dsl import entries

    lines = ["a = b", "# One", "> blurb", "Cat = Kitty = Tom -> Felis | seen", "- cat", "= x", ""]
    df = spark.createDataFrame([("u", k, t) for k, t in enumerate(lines)], "unit string, pos int, line string")
    got = {r["pos"]: r for r in entries(df, key="unit", pos="pos", text="line").collect()}
    assert {p: r["error"] for p, r in got.items()} == {0: "orphan", 3: None, 4: "duplicate", 5: "missing"}
    assert got[3]["variants"] == ["Kitty", "Tom"] and got[3]["topic"] == "Felis" and got[3]["note"] == "seen" and got[4]["nested"]


def test_review_step_is_the_batch_step(spark):
    from corpusloom.streaming.stateful import played

    reviews = [("C", 0.2), ("W", 0.9), ("C", None), ("C", 1.0), ("D", 0.1), ("C", 0.0)]
    held = {}
    clock = played(held, 0, [(c, c, 1 if c != 2 else None, *r) for c, r in enumerate(reviews)])
    log = spark.createDataFrame([("u", 1 if c != 2 else None, c, *r) for c, r in enumerate(reviews)], "uid string, k long, clock long, res string, bf double")
    row = ordered.replay(log.where("k is not null")).first()
    state = held[1]
    assert clock == 6 and [row["reps"], row["lapses"], row["last"]] == state[2:] and abs(row["stab"] - state[0]) < 1e-9 and abs(row["diff"] - state[1]) < 1e-9
    # the first two by hand: grade 0.8 at difficulty 5 - 0.15 * 0.4, then a wrong answer
    one = {}
    played(one, 0, [(0, 0, 1, "C", 0.2)])
    stab, diff = one[1][:2]
    assert abs(diff - 4.94) < 1e-12 and abs(stab - 2 * (1 + 0.606 * 1.2)) < 1e-12
    played(one, 1, [(1, 1, 1, "W", 0.9)])
    assert abs(one[1][1] - 6.04) < 1e-12 and abs(one[1][0] - max(1.0, 0.35 * stab)) < 1e-12 and one[1][2:] == [2, 1, 1]


def test_stream_replays_late_attempts_in_order(spark, tmp_path):
    """Attempts that come late, within the bound, give the state of the whole log in order."""
    from corpusloom.sources.tables import upsert
    from corpusloom.streaming import log as L
    from corpusloom.streaming import stateful as S

    minutes = [[0, 50, 20], [10, 70, 40], [60, 100, 90, 130]]
    rows = [(7, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", m, m % 4, "CWD"[m % 3], (m % 10) / 10) for batch in minutes for m in batch]
    schema = "uid long, ts string, event_id long, k long, res string, bf double"
    at = 0
    for n, batch in enumerate(minutes):
        part = spark.createDataFrame(rows[at : at + len(batch)], schema).withColumn("at", F.to_timestamp("ts"))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
        at += len(batch)
    files = sorted((tmp_path / "in").glob("*/part*.parquet"))
    (tmp_path / "all").mkdir()
    import os
    import shutil

    for n, f in enumerate(files):
        shutil.copy(f, tmp_path / "all" / f"{n}.parquet")
        os.utime(tmp_path / "all" / f"{n}.parquet", (1_700_000_000 + 60 * n,) * 2)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    with L.keyed_state(spark):
        got = upsert(L.drained(S.replayed(stream), spark, "update"), ["uid", "k"], [F.col("_batch")])
    whole = spark.createDataFrame(rows, schema)
    want = ordered.replay(ordered.clocked(whole))
    key = lambda r: (r["k"], r["reps"], r["lapses"], r["last"], round(r["stab"], 9), round(r["diff"], 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))



def test_sentence_ends_follow_initials_and_abbreviations():
    cases = {
        "He met Mr. Smith. Then W. E. B. left.": ["He met Mr. Smith.", "Then W. E. B. left."],
        "The U.S. Army won. It left Georgia. Next": ["The U.S. Army won.", "It left Georgia.", "Next"],
        'He said "No." Then e.g. This. (He left.) 9 more': ['He said "No." Then e.g. This.', "(He left.)", "9 more"],
        "It ended! but went on? Yes.": ["It ended! but went on?", "Yes."],
        "See Nos. 4 and No. 5. “Quoted.” End": ["See Nos. 4 and No. 5.", "“Quoted.”", "End"],
    }
    for source, want in cases.items():
        assert text.sentences(source) == want, source


def test_clues_of_tossups_and_bonuses(spark):
    from corpusloom.operators import clues

    df = spark.createDataFrame([(1, 'This man ("MAHN") ran. [read slowly] For 10 points, name him.', "<b>This man <i>ran</i>.</b> For 10 points, name him."), (2, None, None)], "id int, q string, html string")
    got = [(r["id"], r["pos"], r["text"], r["in_power"], r["is_giveaway"]) for r in clues.tossup_clues(df, id_col="id", text_col="q", html_col="html").collect()]
    assert got == [(1, 0, "This man  ran.", False, False), (1, 1, "For 10 points, name him.", False, True)]
    df = spark.createDataFrame([(1, "Lead", ["p1", "p2", "p3"], ["a1", "a2"]), (2, "x", None, ["a"])], "id int, l string, p array<string>, a array<string>")
    got = [tuple(r) for r in clues.bonus_clues(df, id_col="id", leadin_col="l", parts_col="p", answers_col="a").collect()]
    assert got == [(1, 0, "p1", "a1", "Lead"), (1, 1, "p2", "a2", "Lead")]


def test_alternative_keys_drop_rejects(spark):
    from corpusloom.functions import text as T
    from corpusloom.operators import clues

    lines = ["Georgia Totto <b><u>O'Keeffe</u></b> [or the O'Keefe; accept Georgia (Totto), do not accept Stieglitz; prompt on painter]", "(Paul) <b><u>Café</u></b>", "[or Later]", None]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, a string")
    got = {}
    for r in sorted(clues.alternative_keys(df, id_col="id", answer_col="a").collect(), key=lambda r: (r["id"], r["place"])):
        got.setdefault(r["id"], []).append(r["key"])
    assert got == {0: ["georgia totto o keeffe", "o keefe", "georgia"], 1: ["cafe"], 2: ["later"]}
    assert [r[0] for r in df.orderBy("id").select(T.bold_core(F.col("a"))).collect()] == ["O'Keeffe", "Café", None, None]


def test_half_floats_are_those_of_numpy(spark):
    import numpy as np
    from corpusloom.functions.numeric import half_float

    bits = list(range(0, 1 << 16, 97)) + [0x7C00, 0xFC00, 0x7C01, 0, 0x8000, 1, 0x3C00]
    got = [r[0] for r in spark.createDataFrame([(k, b) for k, b in enumerate(bits)], "k int, b int").orderBy("k").select(half_float(F.col("b"))).collect()]
    want = np.array(bits, np.uint16).view(np.float16).astype(float)
    assert np.array_equal(np.array(got, float), want, equal_nan=True)


def test_years_and_work_names(spark):
    text_ = "In 1848 and 1848, 2029 or 2030; 44 BC, 300 B.C. and 12 bce. A999 17763"
    row = spark.createDataFrame([(text_, "The Boat (1875) / Le Bateau, c. 1870"), (None, "Crow, c. 1650s version")], "t string, w string").select(text.years(F.col("t")).alias("y"), text.clean_work_name(F.col("w")).alias("w")).collect()
    assert row[0]["y"] == [1848, 2029, -44, -300, -12] and row[0]["w"] == "The Boat" and row[1]["y"] is None and row[1]["w"] == "Crow"


def test_links_stand_outside_tags_and_longest_first():
    html = "The <b title='Ode'>ode</b> to joy, Ode to Joy and ode, or /Ode."
    got = text.linked(html, ["Ode", "Ode to Joy", "joy", ""])
    assert got == "The <b title='Ode'><a href=\"#ode\">Ode</a></b> to <a href=\"#joy\">joy</a>, <a href=\"#ode-to-joy\">Ode to Joy</a> and ode, or /Ode."
    assert text.linked("plain", []) == "plain"
