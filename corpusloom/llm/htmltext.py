"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each
block of text, and counts for each the characters and the tags around them.  The
ratios are smoothed with a Gaussian over neighbouring lines, and lines above the
threshold (their standard deviation, as in content extraction via tag ratios) form
the clusters that select the content regions.  A region is the page's element
that holds the selected text: its article or main elements if they hold over half
of it, else the deepest element with most of that text.  In an article or main element
the blocks beside each other in its text are judged: paragraphs, headings, lists and bare
blocks of text stay, however short; a block that nests others, such as an unmarked advert or
teaser between paragraphs, stays only if its own text-to-tag ratio reaches the threshold, and
no block of links alone does.  Elsewhere the
clusters decide line by line: selected lines and those between clusters stay, others
only in paragraphs, headings and lists beside a selected block, and not if they are
links alone.  Elements whose tag, role or a whole class or id says menu, header,
footer, sidebar, notice, advert, form or reader comment are vetoed anywhere.

Defined cases: null, empty and text-free pages have empty text; broken markup is
read as far as the parser goes and never fails; equal pages give equal text;
repeated rows are repeated in the result; a page of any length is read whole;
an empty table gives an empty result; equal ratios are all above the threshold or
all below; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

SIGMA = 1.5
#: Share of the selected text that the deepest element must hold to be the region.
MOST_OF_TEXT = 0.8

#: Blocks of text that belong to the selected blocks beside them.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button".split())
APART = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup sidebar rail widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager header masthead footer share sharing social related recommended recommendations trending "
    "comment comments commentlist disqus reply replies respond login search toolbar skip disclaimer".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
IN_SCOPE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
CLOSES_P = BLOCKS - {"option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr", "legend", "html", "body"}
FENCES = frozenset("article main section div aside nav header footer form table td th ul ol dl blockquote body".split())
#: Elements that can hold the blocks of a text side by side.
HOLDERS = frozenset("article main section div body td".split())


def named_apart(names: str) -> bool:
    """Whether one of the class or id tokens is made of marks alone, as ``ad`` or ``cookie-banner``."""
    return any((words := WORD.findall(name)) and all(w.lower() in MARKS for w in words) for name in names.split())


def marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is apart from the main text by its tag, role, class or id."""
    if tag in APART:
        return True
    if tag in ("html", "body", "main", "article"):
        return any(k in ("class", "id") and tag == "article" and {"comment", "comments", "reply"} & {w.lower() for w in WORD.findall(v or "")} for k, v in attrs)
    for k, v in attrs:
        if k in ("class", "id") and v and named_apart(v):
            return True
        if k == "role" and v and v.lower() in ROLES:
            return True
        if k == "hidden" or (k == "aria-hidden" and v == "true"):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: text, tags around it, and the elements that it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, element number, apart, silent, in a link
        self.parent: list[int] = []
        self.kind: list[str] = []
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0
        self.lines: list[tuple[str, int, int, bool, bool]] = []  # text, tags, element, apart, links only

    def _flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            of = next((x[1] for x in reversed(self.stack) if x[0] in BLOCKS), -1)
            self.lines.append((line, self.tags, of, bool(self.stack) and self.stack[-1][2], self.linked >= 0.9 * len(line)))
            self.tags = 0
        self.linked = 0

    def _pop(self, at: int) -> None:
        if any(t in BLOCKS for t, *_ in self.stack[at:]):
            self._flush()
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return
        closes = IN_SCOPE.get(tag)
        if closes or tag in CLOSES_P:
            closes = (closes or frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            for at in range(len(self.stack) - 1, -1, -1):
                open_ = self.stack[at][0]
                if open_ in closes:
                    self._pop(at)
                    break
                if open_ in FENCES:
                    break
        if tag in ("td", "th"):
            self.text.append(" ")
        apart, silent, link = self.stack[-1][2:] if self.stack else (False, False, False)
        number = len(self.parent)
        self.parent.append(self.stack[-1][1] if self.stack else -1)
        self.kind.append(tag)
        self.stack.append((tag, number, apart or marked(tag, attrs), silent or tag in SILENT, link or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            open_ = self.stack[at][0]
            if open_ == tag:
                self._pop(at)
                return
            if tag not in BLOCKS and open_ in FENCES:
                return
            if tag == "p" and open_ in FENCES:
                break
        if tag in BLOCKS:
            self._flush()

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][3]):
            self.text.append(data)
            if self.stack and self.stack[-1][4]:
                self.linked += len(data.strip())


def lines_of(html: str) -> Lines:
    for text in (html, html.replace("<![", "<! [")):
        parser = Lines()
        try:
            parser.feed(text)
            parser.close()
        except (AssertionError, ValueError, IndexError):
            continue
        break
    parser._flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian over lines, normalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    # the whole convolution's middle is as long as the lines, however few they are
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def threshold(ratios: np.ndarray, s: np.ndarray) -> float:
    """The ratio of content: the standard deviation of the lines' ratios, or what the best line reaches."""
    return min(float(ratios.std()), float(s.max()))


def selected(ratios: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio reaches the threshold; all of a page with one kind of line."""
    s = smoothed(ratios)
    return s >= threshold(ratios, s)


def clusters(content: np.ndarray) -> list[tuple[int, int]]:
    """First and last + 1 of each run of selected lines."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], content.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def of_clusters(content: np.ndarray, lines: list, paths: list[list[int]], page: Lines) -> np.ndarray:
    """Lines that the clusters bring with them where no article or main element bounds the text.

    These are the selected lines, the lines between two clusters, and, before the first
    and after the last, lines in paragraphs, headings and lists that stand beside a
    selected line's block; lines of links alone aren't brought along.
    """
    keep = content.copy()
    found = clusters(content)
    if not found:
        return keep
    keep[found[0][0] : found[-1][1]] = True
    beside = {page.parent[p[-1]] for p, c in zip(paths, content) if c and p}
    for k in [*range(found[0][0]), *range(found[-1][1], len(lines))]:
        keep[k] = any(page.parent[e] in beside and page.kind[e] in TEXT_BLOCKS for e in paths[k])
    return keep & (content | ~np.array([links for *_, links in lines]))


def most_of(paths: list[list[int]], size: np.ndarray, taken: np.ndarray, kinds: frozenset[str], page: Lines) -> int | None:
    """The deepest element of some kinds that holds most of the text of the taken lines."""
    held: dict[int, float] = {}
    for k in np.flatnonzero(taken).tolist():
        for e in paths[k]:
            held[e] = held.get(e, 0.0) + size[k]
    whole = float(size[taken].sum())
    wide = [e for e, n in held.items() if n >= MOST_OF_TEXT * whole and page.kind[e] in kinds]
    depth = {e: at for k in np.flatnonzero(taken).tolist() for at, e in enumerate(paths[k])}
    return max(wide, key=lambda e: (depth[e], e)) if wide else None


def strays(regions: set[int], lines: list, paths: list[list[int]], ratios: np.ndarray, size: np.ndarray, content: np.ndarray, page: Lines) -> np.ndarray:
    """Lines within regions that aren't of their text: nested blocks below the threshold, and blocks of links alone."""
    out = np.zeros(len(lines), bool)
    least = threshold(ratios, smoothed(ratios))
    for region in regions:
        inside = np.array([region in p for p in paths])
        body = most_of(paths, size, inside & content, HOLDERS, page)
        blocks: dict[int, list[int]] = {}
        for k in np.flatnonzero(inside).tolist():
            path = paths[k]
            at = path.index(body) if body in path else path.index(region)
            if at + 1 < len(path):
                blocks.setdefault(path[at + 1], []).append(k)
        for block, own in blocks.items():
            if page.kind[block] != "p" and all(lines[k][4] for k in own):
                out[own] = True
            elif page.kind[block] not in TEXT_BLOCKS and any(paths[k][-1] != block for k in own):
                tags = sum(lines[k][1] for k in own)
                out[own] = size[own].sum() / max(1, tags) < least
    return out


def main_text(html: str | None) -> str:
    """The page's main text: lines of the content regions, joined by blank lines."""
    page = lines_of(html or "")
    own = [k for k, line in enumerate(page.lines) if not line[3]]
    if not own:
        return ""
    lines = [page.lines[k] for k in own]
    size = np.array([len(t) for t, *_ in lines], float)
    ratios = size / np.maximum(1, np.array([n for _, n, *_ in lines]))
    content = selected(ratios)
    paths = []
    for _, _, element, *_ in lines:
        path = []
        while element >= 0:
            path.append(element)
            element = page.parent[element]
        paths.append(path[::-1])
    for kind in ("article", "main"):
        regions = {e for p, c in zip(paths, content) if c for e in p if page.kind[e] == kind}
        inside = np.array([not regions.isdisjoint(p) for p in paths])
        if size[content & inside].sum() > 0.5 * size[content].sum():
            break
    else:
        wide = most_of(paths, size, content, FENCES, page)
        regions = None if wide is None else {wide}
    inside = np.array([regions is None or not regions.isdisjoint(p) for p in paths])
    if regions is not None and any(page.kind[e] in ("article", "main") for e in regions):
        inside &= ~strays(regions, lines, paths, ratios, size, content, page)
    else:
        inside &= of_clusters(content & inside, lines, paths, page)
    kept = np.flatnonzero(inside).tolist()
    return "\n\n".join(lines[k][0] for k in kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def make():
        def step(batch: pa.RecordBatch):
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

        return step

    return map_batches(rows, make, "page_id long, url string, text string, n_chars long")
