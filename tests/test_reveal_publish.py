"""Reveal units, publishing in two phases, and scans of broken files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import reveal
from corpusloom.sources import publish, tables

TEXTS = {
    # a run that dashes join comes apart; each note but the first stands without a blank
    "It opens E–F♯–G–E, softly": (["It", "opens", "E–", "F♯–", "G–", "E,", "softly"], [" ", " ", " ", "", "", "", " "], [2, 3, 4, 5]),
    # an alteration stays with its note
    "B-flat-C-D-sharp-E then": (["B-flat-", "C-", "D-sharp-", "E", "then"], None, [0, 1, 2, 3, 4]),
    # two notes are no run, neither are other words with dashes
    "A–B is-not-one sol–fa": (["A–B", "is-not-one", "sol–fa"], None, []),
    # words about notes go on with a run and don't count
    "the notes C, long D and then E flat end": (["the", "notes", "C,", "long", "D", "and", "then", "E", "flat", "end"], None, [2, 3, 4, 5, 6, 7, 8]),
    # at most three words join two notes
    "C D up and down again E F": (None, None, []),
    "C D up and down E F": (None, None, [0, 1, 2, 3, 4, 5, 6]),
    # what joins behind the last note still belongs to the run, up to three words
    "do re mi back to a an x": (None, None, [0, 1, 2, 3, 4, 5]),
    "“C” D's E-sharp. – F": (None, None, [0, 1, 2, 3, 4]),
    "Cs and Ds": (None, None, []),
    "cat c d e": (None, None, []),
    "": ([], [], []),
    "   ": ([], [], []),
    "one (*) two (+) (*)": (["one", "(*)", "two", "(+)", "(*)"], None, []),
}


def test_units_notes_and_marks(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string").select("text", reveal.units(F.col("text")).alias("u"))
    rows = df.select("*", reveal.first_unit(F.col("u"), "(*)").alias("power"), reveal.first_unit(F.col("u"), "(+)").alias("more"), reveal.shown_ms(F.col("u"), 100).alias("ms")).collect()
    for r in rows:
        if r.text is None:
            assert r.u is None
            continue
        units, seps, slow = TEXTS[r.text]
        assert units is None or [u.t for u in r.u] == units, r.text
        assert seps is None or [u.sep for u in r.u] == seps
        assert [k for k, u in enumerate(r.u) if u.slow] == slow, r.text
        assert abs(r.ms - 100 * (len(r.u) + 1.4 * len(slow))) < 1e-6
        assert (r.power, r.more) == ((1, 3) if "(*)" in r.text else (None, None))


def state(out, version=None):
    return sorted((r.artifact, r.k, r.v, r.since) for r in out.read("k long, v string", version).collect())


def test_publishing_switches_once_and_writes_what_changed(spark, tmp_path):
    out = publish.Published(spark, str(tmp_path / "out"))
    assert out.version() == 0 and out.manifest().count() == 0 and state(out) == [] and out.unreferenced() == []
    rows = lambda *r: spark.createDataFrame(r, "name string, k long, v string")
    assert out.publish(rows(("a", 1, "x"), ("a", 2, None), ("b", 3, "y")), "name") == 1
    assert out.publish(rows(("b", 3, "y"), ("a", 2, None), ("a", 1, "x")), "name") == 2  # other order, same content
    assert {r.since for r in out.manifest().collect()} == {1}
    assert out.publish(rows(("a", 1, "x"), ("a", 2, ""), ("c", 4, "z")), "name") == 3
    assert state(out) == [("a", 1, "x", 3), ("a", 2, "", 3), ("c", 4, "z", 3)]
    assert state(out, 1) == [("a", 1, "x", 1), ("a", 2, None, 1), ("b", 3, "y", 1)]
    assert out.read("k long, v string", where=F.col("artifact") == "c").count() == 1
    assert out.publish(rows(("d", 5, "w")).limit(0), "name") == 4 and state(out) == []


def test_a_failed_run_leaves_the_old_version(spark, tmp_path):
    out = publish.Published(spark, str(tmp_path / "out"))
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "name string, k long, v string")
    out.publish(rows, "name")
    before = state(out)
    # a row whose value can't be computed fails the run while data are written
    bad = rows.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("no such value"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no such value"):
        out.publish(bad, "name")
    assert out.version() == 1 and state(out) == before
    with pytest.raises(ValueError, match="no name"):
        out.publish(rows.withColumn("name", F.lit(None).cast("string")), "name")
    # a run that dies between its data and the switch is invisible as well
    switch, out._switch = out._switch, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        out.publish(rows.withColumn("v", F.lit("new")), "name")
    assert out.version() == 1 and state(out) == before and len(out.unreferenced()) == 1
    out._switch = switch
    assert out.publish(rows.withColumn("v", F.lit("new")), "name") == 2 and [r[2] for r in state(out)] == ["new", "new"]


def test_of_two_writers_one_fails(spark, tmp_path):
    out, other = (publish.Published(spark, str(tmp_path / "out")) for _ in range(2))
    rows = spark.createDataFrame([("a", 1, "x")], "name string, k long, v string")
    out.publish(rows, "name")
    switch = out._switch

    def late(version, run):
        other.publish(rows.withColumn("v", F.lit("theirs")), "name")
        switch(version, run)

    out._switch = late
    with pytest.raises(publish.Conflict):
        out.publish(rows.withColumn("v", F.lit("ours")), "name")
    assert out.version() == 2 and [r[2] for r in state(out)] == ["theirs"]


def test_broken_files_are_rows(spark, tmp_path):
    for name, text in {"good": '{"title": "x"}', "cut": '{"title": "x', "empty": "", "list": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = tables.tolerant_json(spark, str(tmp_path / "*.json"), StructType.fromDDL("title string"))
    assert [tuple(r) for r in good.where("title is not null").collect()] == [("good", "x")] and "cut" in {r.slug for r in bad.collect()}
