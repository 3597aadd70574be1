"""Operator 7, main text of web pages from parser events and text-to-tag ratios.

The events of the standard library's parser are cut into lines, one for each
block element with text. Lines in elements whose tag holds no article text (menus,
forms, scripts) are dropped. Each line left has a ratio of characters to tags; the
ratios are smoothed by a Gaussian kernel, and lines whose own and smoothed ratio are
not under one standard deviation, or under PROSE if that is less, are the core: one
very long block cannot raise the limit above that of plain prose. The content region
is the smallest element that holds the whole core, or the article or main around it.
Where such elements hold most of the core, only what is in them counts as core. In
the region all lines are kept but those mainly of links that stand apart from it.

A role, class or id is evidence only, as is a form: what it marks goes, unless it holds
an article without mark or a main, or more than half of the page's core text and the
page does not have its one article without mark elsewhere. A mark
that may be a heading of the article (``discussion``, ``related``) counts inside an article
only where the text under it is not prose: less than half in core lines. Inside an
article element lines of links stay, as do they between the core's first and last line.

Defined results: null, empty or tag-only html gives the empty text; broken markup
is read as far as the parser makes sense of it, never raised; null page ids and
urls and repeated rows come back row by row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm.common import bound_batches, slices
from tarnfield.sources import read_table

#: Lines and standard deviations: kernel radius and its width.
RADIUS, WIDTH = 2, 1.0
#: Characters to a tag that are prose in any page.
PROSE = 30.0
#: Least share of the core that article or main elements hold to be the content.
ARTICLE_SHARE = 0.1

# HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer frame head iframe input map menu nav noscript object option"
    " progress script select style svg template textarea title video".split()
)
# Elements that hold no article text unless most of the page's core is in them.
WRAPPERS = frozenset("fieldset form".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner cookie cookies consent"
    " gdpr notice notices notification popup modal overlay sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer"
    " masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations"
    " newsletter subscribe subscription signup login paywall pagination pager skip hidden complementary contentinfo search alert copyright".split()
)
# Marks that are headings of articles too, so prose under them inside an article stays.
AMBIGUOUS = frozenset("alert copyright discussion promotion recommendations recommended related replies respond search subscription".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Line:
    """One block of text: its white space folded, its tags and link characters counted.

    ``parts`` are (text, whether a link, the marked elements around it).
    """

    __slots__ = ("links", "parts", "path", "tags", "text")

    def __init__(self, parts: list[tuple[str, bool, tuple[int, ...]]], tags: int, path: tuple[int, ...]):
        self.parts, self.tags, self.path = parts, tags, path
        self.text = _SPACE.sub(" ", "".join(t for t, _, _ in parts)).strip()
        self.links = sum(len(t) for t, link, _ in parts if link)

    def without(self, gone: set[int]) -> Line:
        """The line with a space for each part inside the elements ``gone``."""
        if not any(marks and not gone.isdisjoint(marks) for _, _, marks in self.parts):
            return self
        return Line([(" ", False, ()) if not gone.isdisjoint(marks) else (t, link, marks) for t, link, marks in self.parts], self.tags, self.path)


class Lines(HTMLParser):
    """Collects the lines of a page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, whether dropped, marked, a block on the path
        self.path: tuple[int, ...] = ()
        self.marks: tuple[int, ...] = ()  # marked elements that are open
        self.holders: set[int] = set()  # marked elements that hold a main, or an article without mark
        self.inside: set[int] = set()  # marked elements inside an article or main
        self.alone: set[int] = set()  # articles without mark, by their number on the path
        self.headings: set[int] = set()  # marked elements in an article whose mark may be a heading's
        self.kinds: dict[int, str] = {}  # article and main elements by their number on the path
        self.blocks = self.marked = self.dropped = self.anchors = self.articles = 0
        self.parts: list[tuple[str, bool, tuple[int, ...]]] = []
        self.tags = 0

    def flush(self) -> None:
        if self.parts:
            line = Line(self.parts, max(1, self.tags), self.path)
            if line.text:
                self.lines.append(line)
            self.parts = []
        self.tags = 0

    def _unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":
            return not self.articles
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _named(self, attrs: list[tuple[str, str | None]]) -> set[str]:
        """The words of class, id and role that mark what is not the article."""
        found: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = set(_SPLIT.split(_CAMEL.sub("-", value).lower()))
                found |= words & MARKS
                if "header" in words and not self.articles:
                    found.add("header")
        return found

    def _pop(self) -> None:
        tag, dropped, marked, block = self.open.pop()
        self.dropped -= dropped
        if marked:
            self.marks = self.marks[:-1]
        self.anchors -= tag == "a"
        self.articles -= tag in ("article", "main")
        if block:
            self.path = self.path[:-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if self.open and self.open[-1][0] != "p" and any(x[0] == "p" for x in self.open[-8:]):
                self._close("p")
            elif self.open and self.open[-1][0] == "p":
                self._pop()
            for other in CLOSES.get(tag, ()):
                if self.open and self.open[-1][0] == other:
                    self._pop()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "img", "wbr") and not self.dropped:
                self.parts.append((" " if tag != "wbr" else "", False, self.marks))
            return
        dropped = self._unwanted(tag, attrs)
        if dropped and tag not in BLOCK and not self.dropped:
            self.parts.append((" ", False, self.marks))
        named = self._named(attrs) if not self.dropped and not dropped and tag not in ("html", "body") else set()
        marked = tag in WRAPPERS and not self.dropped or bool(named) and tag not in ("main", "article")
        block = tag in BLOCK and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr")
        self.open.append((tag, dropped, marked, block))
        self.dropped += dropped
        self.anchors += tag == "a"
        self.articles += tag in ("article", "main")
        if block:
            self.blocks += 1
            self.path = (*self.path, self.blocks)
        if marked:
            self.marked += 1
            self.marks = (*self.marks, self.marked)
            if self.articles:
                self.inside.add(self.marked)
                if named and named <= AMBIGUOUS and tag not in WRAPPERS:
                    self.headings.add(self.marked)
        if tag in ("article", "main"):
            self.kinds[self.blocks] = tag
            if tag == "article" and not named:
                self.alone.add(self.blocks)
            if not named or tag == "main":
                self.holders.update(self.marks)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but void elements, and those are none to close

    def _close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            own = self.open[k][0]
            if own == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if own in BLOCK and (tag not in BLOCK or tag == "p"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append((data, self.anchors > 0, self.marks))

    def unknown_decl(self, data: str) -> None:
        pass


def parsed(html: str) -> Lines:
    for source in (html, html.replace("<![", "&lt;![")):  # the second way for sections the parser refuses
        reader = Lines()
        try:
            reader.feed(source)
            reader.close()
        except AssertionError:
            continue
        reader.flush()
        return reader
    return Lines()


_KERNEL = [math.exp(-(k * k) / (2 * WIDTH * WIDTH)) for k in range(-RADIUS, RADIUS + 1)]


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    n, out = len(ratios), []
    for k in range(n):
        low, high = max(0, k - RADIUS), min(n, k + RADIUS + 1)
        kernel = _KERNEL[low - k + RADIUS : high - k + RADIUS]
        out.append(sum(w * r for w, r in zip(kernel, ratios[low:high])) / sum(kernel))
    return out


def dense(lines: list[Line]) -> list[int]:
    """Places of the core lines."""
    if not lines:
        return []
    own = [len(x.text) / x.tags for x in lines]
    ratios = smoothed(own)
    mean = sum(ratios) / len(ratios)
    limit = min(PROSE, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    return [k for k, x in enumerate(lines) if min(own[k], ratios[k]) >= limit and 2 * x.links <= len(x.text)]


def unmarked(page: Lines) -> list[Line]:
    """The lines without what names mark, as far as the text does not speak against it."""
    if not page.marked:
        return page.lines
    places = set(dense(page.lines) or range(len(page.lines)))
    total, held, own = 0, dict.fromkeys(range(1, page.marked + 1), 0), dict.fromkeys(page.headings, 0)
    for k, line in enumerate(page.lines):
        for text, _, marks in line.parts:
            total += len(text) if k in places else 0
            for m in marks:
                if k in places:
                    held[m] += len(text)
                if m in own:
                    own[m] += len(text)
    prose = {m for m, n in own.items() if 2 * held[m] > n}
    single = len(page.alone) == 1 and any(not page.alone.isdisjoint(x.path) for x in page.lines)
    weak = lambda m, n: 2 * n <= total or (single and m not in page.inside)
    gone = {m for m, n in held.items() if m not in page.holders and m not in prose and weak(m, n)}
    return [x for x in (line.without(gone) for line in page.lines) if x.text]


def content(page: Lines) -> list[str]:
    """Texts of the lines in the content region, in page order."""
    lines = unmarked(page)
    core = dense(lines)
    if not core:
        return [x.text for x in lines if 2 * x.links <= len(x.text)]
    mass = lambda places: sum(len(lines[k].text) for k in places)
    for kind in ("article", "main"):
        inside = [k for k in core if any(page.kinds.get(b) == kind for b in lines[k].path)]
        rest = [k for k in core if not any(marks for _, _, marks in lines[k].parts)]
        if inside and mass(inside) >= ARTICLE_SHARE * mass(core) and 2 * mass(inside) >= mass(set(rest) | set(inside)):
            core = inside
            break
    first, last = min(lines[k].path for k in core), max(lines[k].path for k in core)
    depth = next((d for d, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    region = first[:depth]
    around = [d for d, b in enumerate(region) if b in page.kinds]
    if around:
        region = region[: around[-1] + 1]
    parents = {lines[k].path for k in core} | {region}
    in_article = any(page.kinds.get(b) == "article" for b in region)
    kept = lambda k, x: in_article or core[0] <= k <= core[-1] or x.path in parents or 2 * x.links <= len(x.text)
    return [x.text for k, x in enumerate(lines) if x.path[: len(region)] == region and kept(k, x)]


def main_text(html: str | None) -> str:
    return "\n".join(content(parsed(html))) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    bound_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extracted(read_table(spark, sf_dir, "pages"))
