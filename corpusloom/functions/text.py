"""String functions as Column expressions; Arrow UDFs only where Unicode tables are needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

ARTICLE = r"^(?:the|an|a) +"
# Letters that decomposition leaves whole, and what stands for them.
TRANSLITERATED = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}
# Abbreviations after which a full stop doesn't end a sentence; those with dots end in an initial.
ABBREVIATIONS = frozenset("Mr Mrs Ms Dr St Sts Mt vs etc Jr Sr Prof Gen Col Fr ca No Op Nos".split())
# Marks that end a sentence, marks that may close it, and what the next may begin with besides A-Z and 0-9.
ENDS, CLOSERS, STARTS = ".!?", "”\")]", "“”\"("


def ascii_key(c: Column) -> Column:
    """Match key of ASCII text, without Python: lower case, words only, one leading article dropped."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "))
    return F.regexp_replace(words, ARTICLE, "")


def fold(text: str) -> str:
    """Decompose and drop marks."""
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


def match_key(text: str | None) -> str | None:
    """Key of a name: marks dropped, letters transliterated, words only, one leading article dropped."""
    if text is None:
        return None
    low = fold(text).lower()
    low = "".join(TRANSLITERATED.get(ch, ch) for ch in low)
    return re.sub(ARTICLE, "", " ".join(re.sub(r"[^\w\s]", " ", low).split()))


def drill_key(text: str | None) -> str | None:
    """Key of an answer: marks dropped, anything but a-z and 0-9 a blank, one leading article dropped."""
    if text is None:
        return None
    return re.sub(ARTICLE, "", " ".join(re.sub(r"[^a-z0-9 ]", " ", fold(text).lower()).split()))


@F.pandas_udf(StringType())
def match_key_udf(s: pd.Series) -> pd.Series:
    return s.map(match_key)


@F.pandas_udf(StringType())
def drill_key_udf(s: pd.Series) -> pd.Series:
    return s.map(drill_key)


def _ascii_apart(c: Column | str, plain: Callable[[Column], Column], other: Callable[[Column], Column]) -> Column:
    """ASCII texts by built-ins; only others reach Python, the rest go there as nulls."""
    c = F.col(c) if isinstance(c, str) else c
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, plain(c)).otherwise(other(F.when(~ascii_only, c)))


def key(c: Column | str) -> Column:
    """Match key of any text."""
    return _ascii_apart(c, ascii_key, match_key_udf)


def answer_drill_key(c: Column | str) -> Column:
    """Key of any answer, with underscores as blanks."""
    plain = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), ARTICLE, "")
    return _ascii_apart(c, plain, drill_key_udf)


def clean_answerline(c: Column) -> Column:
    """Display form: tags stripped, cut at the first bracket, round brackets dropped, blanks collapsed, edges trimmed."""
    c = F.regexp_replace(c, r"<[^>]*>", "")
    c = F.regexp_replace(c, r"\[[\s\S]*", "")
    c = F.regexp_replace(c, r"\([^)]*\)", "")
    c = F.regexp_replace(c, r"[ \t\r\n]+", " ")
    return F.regexp_replace(c, r"^[ ;,]+|[ ;,]+$", "")


def answer_core(c: Column) -> Column:
    """The first span with text among underlined, else among bold ones, else the text before a bracket."""

    def span(tag: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
        return F.get(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))

    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[\[(][\s\S]*", ""))
    return F.coalesce(span("u"), span("b"), plain)


def slug(c: Column, sep: str = "-") -> Column:
    """Lower-case words joined by ``sep``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", sep), rf"^{sep}+|{sep}+$", "")


def ends_sentence(word: str) -> bool:
    """Whether a word ends a sentence by itself: a mark, closed or not, that isn't of an abbreviation or an initial."""
    plain = word.rstrip(CLOSERS)
    if not plain or plain[-1] not in ENDS:
        return False
    if plain[-1] != ".":
        return True
    body = plain[:-1]
    letters = len(body) - len(body.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    last = re.search(r"\w*$", body)[0]
    return letters != 1 and last not in ABBREVIATIONS


def sentences(text: str | None) -> list[str]:
    """Split at words that end a sentence and before a likely start: a capital, a digit, a quote or a round bracket."""
    words = list(re.finditer(r"\S+", text or ""))
    out, begin = [], 0
    for k, m in enumerate(words):
        after = words[k + 1][0][0] if k + 1 < len(words) else "A"
        if ends_sentence(m[0]) and (after in STARTS or "A" <= after <= "Z" or "0" <= after <= "9"):
            out.append(text[begin : m.end()].strip())
            begin = m.end()
    rest = (text or "")[begin:].strip()
    return out + [rest] * (rest != "")


@F.pandas_udf(ArrayType(StringType()))
def sentences_udf(s: pd.Series) -> pd.Series:
    return s.map(sentences)


def simple_sentences(c: Column) -> Column:
    """Split after a mark that white space follows, without Python."""
    parts = F.split(F.regexp_replace(c, r"([.!?])[ \n]+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


# Words that say nothing about a clue.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its", "name",
    "of", "on", "one", "or", "that", "the", "this", "these", "those", "to", "was", "were", "which", "with", "points", "ten", "work", "works",
    "composer", "author", "artist", "man", "title", "titular",
)
CONTENT_WORD = "[a-zà-ÿ0-9']+"


def content_words(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words of over two letters, digits or apostrophes that aren't stop words, in order of first sight."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({CONTENT_WORD})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def content_words_sql(column: str, stop: tuple[str, ...] = STOP_WORDS) -> str:
    """The same for DuckDB, repeats included."""
    listed = ", ".join(f"'{w}'" for w in stop)
    pattern = CONTENT_WORD.replace("'", "''")
    return f"list_filter(regexp_extract_all(lower({column}), '{pattern}'), lambda w: length(w) > 2 AND w NOT IN ({listed}))"


def bounded(phrase: str) -> str:
    """A pattern for ``phrase`` between word edges, the same in Java and RE2."""
    return r"(?i)(^|[^A-Za-z0-9_])" + re.escape(phrase).replace(r"\ ", " ") + r"([^A-Za-z0-9_]|$)"


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def giveaway(c: Column, most: int = 220) -> Column:
    """The last sentence, if it isn't longer than ``most``."""
    last = F.element_at(simple_sentences(c), -1)
    return F.when(F.length(last) <= most, last)


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def bold_text(html: Column) -> Column:
    """The text of all bold spans, joined by blanks."""
    return F.concat_ws(" ", F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<b>(.*?)</b>"), F.lit(1)), without_tags))


def in_power(sentence: Column, html: Column, width: int = 40) -> Column:
    """Whether a sentence begins inside the bold text: its first ``width`` characters occur there."""
    return F.contains(bold_text(html), F.substring(sentence, 1, width))


def is_giveaway(sentence: Column) -> Column:
    return sentence.rlike(r"(?i)for (?:10|ten) points")


def without_guides(c: Column) -> Column:
    """A question without quoted pronunciation guides and the direction to read slowly."""
    return F.regexp_replace(F.regexp_replace(c, r"\(\"[\w\s\-'.]+\"\)", ""), r"\[read slowly\]\s*", "")


def bold_core(raw: Column) -> Column:
    """The bold and underlined span of an answer line, the least that is accepted; null without one."""
    found = F.regexp_extract_all(raw, F.lit(r"(?s)<b><u>(.*?)</u></b>"), F.lit(1))
    return without_tags(F.get(found, F.lit(0)))


def alternatives(answer: Column) -> Column:
    """The answer before a square bracket and each alternative inside one that is accepted, in order.

    Alternatives are parted by semicolons, commas and "or"; those that say what to reject or
    prompt on are left out; round brackets become blanks.
    """
    plain = without_tags(answer)
    groups = F.regexp_extract_all(plain, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"[;,]| or "))), lambda x: F.trim(x))
    accepted = F.filter(parts, lambda x: (x != "") & ~x.rlike(r"(?i)^(?:do not|reject|antiprompt|prompt)\b"))
    named = F.transform(accepted, lambda x: F.regexp_replace(x, r"(?i)^(?:or|accept|and|also accept)\s+", ""))
    every = F.concat(F.array(F.split(plain, r"\[")[0]), named)
    return F.filter(F.transform(every, lambda x: F.trim(F.regexp_replace(x, r"\([^)]*\)", " "))), lambda x: x != "")


def years(c: Column) -> Column:
    """Distinct years that a text names, once each: 1000 to 2029 as they are, years BC as negative numbers."""
    after = F.transform(F.regexp_extract_all(c, F.lit(r"\b(1[0-9]{3}|20[0-2][0-9])\b"), F.lit(1)), lambda y: y.cast("int"))
    before = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b([0-9]{1,4})\s*(?:BCE?|B\.C\.?)\b"), F.lit(1)), lambda y: -y.cast("int"))
    return F.array_distinct(F.concat(after, before))


def clean_work_name(c: Column) -> Column:
    """A work's name for a search: without round brackets, what follows a slash, and a date about which it was made."""
    c = F.trim(F.regexp_replace(c, r"\(.*?\)", ""))
    c = F.trim(F.regexp_replace(c, r"\s*/\s*.*", ""))
    return F.trim(F.regexp_replace(c, r",?\s*c\.\s*[0-9]{4}.*", ""))


def linked(html: str, names: list[str], link=lambda name: f'<a href="#{name.lower().replace(" ", "-")}">{name}</a>') -> str:
    """The first place of each name, whole words in any case, as a link; longer names first, never inside a tag or a link."""
    # the text is held in pieces; only plain ones are looked through
    pieces = [(bool(k % 2), p) for k, p in enumerate(re.split(r"(<[^>]*>)", html))]
    for name in sorted(set(filter(None, names)), key=lambda n: (-len(n), n)):
        whole = re.compile(r"(?<![\w/])" + re.escape(name) + r"(?!\w)", re.I)
        for k, (fixed, piece) in enumerate(pieces):
            hit = None if fixed else whole.search(piece)
            if hit:
                pieces[k : k + 1] = [(False, piece[: hit.start()]), (True, link(name)), (False, piece[hit.end() :])]
                break
    return "".join(p for _, p in pieces)


@F.pandas_udf(StringType())
def linked_udf(html: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else linked(h, list(n) if n is not None else []) for h, n in zip(html, names)], dtype=object)
