"""Units in which a question is revealed: words, single notes of a run of notes, and what is read slowly.

All of it is built-in functions: words become one letter each for what they are, runs of notes
are a pattern over these letters, and the flags come back from the lengths of what matched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that parts words; dashes; marks that may open a note, close one, or close a word about notes.
BLANK = r"[\t\n\x0B\f\r    -     　﻿]+"
DASHES, OPENERS, CLOSERS = "–—-", "\"“(«", "”\")»],.;:!?"
# Names of notes, what may stand behind them, words that go on with a run of notes and words that only join two parts of it.
LETTERS, ACCIDENTALS, ALTERED = "A-G", ("♯", "♭", "#", "b"), ("sharp", "flat", "natural")
SYLLABLES = ("do", "re", "mi", "fa", "sol", "la", "ti", "si")
GOES_ON = (
    "sharp", "sharps", "flat", "flats", "natural", "naturals", "long", "longs", "short", "shorts", "repeated", "dotted", "tied", "slurred", "staccato",
    "triplet", "triplets", "high", "higher", "low", "lower", "note", "notes", "major", "majors", "minor", "minors", "eighth", "eighths", "quarter",
    "quarters", "sixteenth", "sixteenths", "thirty", "second", "halves", "half", "whole", "ascending", "descending", "rising", "falling", "pause", "rest",
    "sustained", "grace", "augmented", "diminished", "perfect", "two", "three", "four", "five", "six", "seven", "eight",
)
JOINS = ("and", "then", "to", "or", "a", "an", "back", "up", "down", "again", "from", "by", "via", "of", "followed")
# Notes that make a run, joining words between two of them, and how much slower a run is shown.
RUN, MOST_JOINS, SLOW_FACTOR = 3, 3, 2.4
POWER, SUPERPOWER = "(*)", "(+)"


def any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def marks(chars: str) -> str:
    return "[" + chars.replace("]", r"\]").replace("-", r"\-") + "]"


_syllable = any_of(tuple(f"[{s[0].upper()}{s[0]}]{s[1:]}" for s in SYLLABLES))
_note = f"(?:[{LETTERS}]{any_of(ACCIDENTALS)}?(?:-?{any_of(ALTERED)})?|{_syllable})"
NOTE = f"^{marks(OPENERS)}?{_note}(?:['’]?s)?{marks(CLOSERS + DASHES)}*$"
CONTINUES = rf"(?i)^(?:double[-\s]?)?{any_of(GOES_ON)}{marks(CLOSERS)}*$|^{marks(DASHES)}+$"
JOINING = rf"(?i)^{any_of(JOINS)}[,.;:]?$"
#: A run in letters n (note), c (continues), g (joins): at most so many joins between two notes and behind the last.
_between = f"c*(?:gc*){{0,{MOST_JOINS}}}"
LETTER_RUN = f"n(?:{_between}n){{{RUN - 1},}}{_between}"
#: After each dash of a word, but where an alteration of the note before follows.
NOTE_BREAK = rf"(?<={marks(DASHES)})(?!$)(?!(?i:{any_of(ALTERED)}(?:{marks(DASHES)}|{marks(CLOSERS.replace('»', ''))}*$)))"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def notes_apart(word: Column) -> Column:
    """A word as the notes that dashes join in it, if it is three notes or more, else as itself."""
    parts = F.split(word, NOTE_BREAK)
    run = word.rlike(marks(DASHES)) & (F.size(parts) >= RUN) & F.forall(parts, lambda p: p.rlike(NOTE))
    return F.when(run, parts).otherwise(F.array(word))


def letter(unit: Column) -> Column:
    return F.when(unit.rlike(NOTE), "n").when(unit.rlike(CONTINUES), "c").when(unit.rlike(JOINING), "g").otherwise("o")


def units(text: Column) -> Column:
    """Array of (t, sep, slow): the units of a text, what stands before each, and whether it belongs to a run of notes."""
    glued = F.flatten(F.transform(words(text), lambda w: F.transform(notes_apart(w), lambda t, i: F.struct(t.alias("t"), F.when(i == 0, " ").otherwise("").alias("sep")))))
    letters = F.array_join(F.transform(glued, lambda u: letter(u["t"])), "")
    pieces = F.regexp_extract_all(letters, F.lit(f"({LETTER_RUN}|.)"), F.lit(1))
    slow = F.flatten(F.transform(pieces, lambda s: F.array_repeat(F.length(s) >= RUN, F.length(s))))
    return F.zip_with(glued, slow, lambda u, s: F.struct(u["t"].alias("t"), u["sep"].alias("sep"), s.alias("slow")))


def first_unit(found: Column, mark: str) -> Column:
    """The place from 0 of the first unit that is ``mark``; null without one."""
    at = F.array_position(F.transform(found, lambda u: u["t"]), mark)
    return F.when(at > 0, (at - 1).cast("int"))


def shown_ms(found: Column, per_unit: int) -> Column:
    """How long a text takes to be shown: ``per_unit`` milliseconds a unit, longer in a run of notes."""
    return F.aggregate(found, F.lit(0.0), lambda s, u: s + F.when(u["slow"], per_unit * SLOW_FACTOR).otherwise(float(per_unit)))
