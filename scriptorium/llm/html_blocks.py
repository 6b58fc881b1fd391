"""HTML extraction by line-block distribution.

Markup is stripped to lines: each block-level boundary ends a line. A line weighs the characters that stand outside
links, so menus stay flat. The distribution is the sum of weights over a sliding window of lines, its threshold a share
of its own mean: a surge point is where the sum rises above the threshold, a dive point where it falls to it. The
window with the largest sum is the core of the page; its surge is the article's, together with

- surges in the same container, or in an ``article`` or ``main`` element when the core is in one (there every text
  counts, and nothing outside of such elements does), and
- elsewhere, surges that are about as dense (text for each line with text) as the core's.

Names only help the distribution. Text in elements named like something around an article (nav, footer, ``class="ad"``)
weighs an eighth in the search for the core. Then such an element goes if it is closed and doesn't hold the core; of one that
is never closed only the text up to the next block goes, so no name and no unclosed tag loses an article.
A surge outside ``article`` and ``main`` takes in lighter paragraphs of its container next to it; light lines before its
first h1, light lines that aren't paragraphs at the ends of a surge of paragraphs, and copyright lines are no part of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches


@dataclass(frozen=True)
class BlockConfig:
    """window: lines in a block. threshold: share of the mean block sum that a surge rises above. density: share of the core's text for each line that a surge in another container needs. names, bounds: whether names of elements, and article and main elements, help."""

    window: int = 3
    threshold: float = 0.1
    density: float = 0.5
    names: bool = True
    bounds: bool = True


_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_SPACE = re.compile(r"\s+")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDING = re.compile(r"""\bhidden(?=[\s/]|$)""")
_NAME_PART = re.compile(r"[a-z]+")
_LINK = re.compile(r"<a[\s>]")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)|all rights reserved", re.I)

#: Elements whose content is no text of the page; of those that are never closed only SWALLOWS take the rest of it.
RAW = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "object", "canvas"))
SWALLOWS = frozenset(("script", "style", "title"))
NEVER = frozenset(("nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part a page: a window of empty lines stands at their ends.
PARTS = frozenset(("nav", "footer", "form", "head", "header", "menu", "dialog"))
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
BODY = frozenset(("article", "main"))
HEADLINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold text of their own kind, whatever stands around them.
TEXT = frozenset(("p", "li", "blockquote", "pre", "dd", "dt", "td", "figcaption", *HEADLINES))
#: Elements that are kept on the stack of open elements; a line's container is the innermost of HOLDERS.
OPEN = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form head header main menu nav ol section table ul button".split())
HOLDERS = frozenset(("article", "aside", "center", "div", "footer", "form", "header", "main", "nav"))
#: Parts of class, id and role names of elements around an article.
HINTS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog gdpr footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond responses search share sharing sidebar sidebars social sponsor sponsored subscribe toolbar topbar widget".split())
#: Those of them that hold prose which isn't the article's, however dense it is.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: Parts of names that say what a page or wrapper is laid out like.
LAYOUTS = frozenset("no not without with has page layout".split())

_DAMPED = 8
_OWNED = 2


def _hinted(names: str, hints: frozenset[str] = HINTS) -> bool:
    """Whether some whole name tells of something around an article; names of layouts (no-sidebar, search-result-page) don't."""
    parts = [set(_NAME_PART.findall(name)) for name in names.lower().split()]
    return any(hints & p and not LAYOUTS & p for p in parts) and not any("layout" in p for p in parts)


def _hidden(attributes: str) -> bool:
    return bool(_HIDING.search(attributes)) or "display:none" in attributes.replace(" ", "").lower()


def _around(name: str, attributes: str, inside: bool) -> int:
    """Whether an element is named like something around an article, or hidden: 0 no, 1 by a name that prose of the article may have too, 2 for certain."""
    if name in NEVER or name == "header" and not inside:
        return 2
    if not attributes or name in BODY or name in ("body", "html"):
        return 0
    names = [m[1] or m[2] or m[3] or "" for m in _HINT.finditer(attributes)]
    if _hidden(attributes) or any(_hinted(x, COMMENTS) for x in names):
        return 2
    return int(any(map(_hinted, names)))


@dataclass(slots=True)
class Line:
    """A line of text, what it weighs, and where it stands: its block element, container and article element (0: none)."""

    text: str
    weight: int
    tag: str = ""
    holder: int = 0
    owner: int = 0


@dataclass(slots=True)
class Around:
    """Lines ``start`` to ``stop`` in an element named like something around an article; ``direct``: end of the text before its first block.

    certain: it is, whatever it holds; owner, holder: the article element and the container that it stands in.
    """

    start: int
    certain: bool = True
    owner: int = 0
    holder: int = 0
    stop: int = -1
    direct: int = -1
    closed: bool = False


class _Page:
    """The lines of a page and its elements named like something around an article."""

    def __init__(self, html: str, config: BlockConfig) -> None:
        self.lines: list[Line] = []
        self.arounds: list[Around] = []
        self.config = config
        self._current: list[str] = []
        self._loose = 0
        self._tag, self._owner, self._owners = "", 0, 0
        self._stack: list[tuple[str, Around | None, int]] = []  # name, what it is, its number as a container
        self._open: Counter[str] = Counter()
        self._named: Counter[str] = Counter()  # open elements of each name inside or equal to one in ``arounds``
        self._holders = 0
        self._read(html)

    def _end_line(self, empty: int = 0) -> None:
        if self._current:
            text = _SPACE.sub(" ", unescape("".join(self._current))).strip()
            self._current.clear()
            if text:
                holder = next((n for name, _, n in reversed(self._stack) if n), 0) if self._stack else 0
                self.lines.append(Line(text, max(1, len(text)) if self._loose else 0, self._tag, holder, self._owner))
        self._loose = 0
        self.lines += [Line("", 0) for _ in range(empty)]
        if self._stack and (around := self._stack[-1][1]) and around.direct < 0:
            around.direct = len(self.lines)

    def _push(self, name: str, around: Around | None) -> None:
        number = 0
        if name in HOLDERS:
            self._holders += 1
            number = self._holders
        self._stack.append((name, around, number))
        self._open[name] += 1
        self._named[name] += around is not None or self._named[name] > 0

    def _pop(self, closed: bool) -> str:
        if self._stack[-1][1]:
            self._end_line()
        name, around, _ = self._stack.pop()
        self._open[name] -= 1
        self._named[name] = max(0, self._named[name] - 1)
        if around:
            around.stop, around.closed = len(self.lines), closed
            around.direct = around.stop if around.direct < 0 else around.direct
        return name

    def _read(self, html: str) -> None:
        at, end, lower, links, headline, config = 0, len(html), html.lower(), 0, False, self.config
        endless: set[str] = set()
        # Where some link is never closed, a block ends it.
        loose_links = len(_LINK.findall(lower)) > lower.count("</a>")
        while at < end:
            m = _TAG.search(html, at)
            text = html[at : m.start() if m else end]
            if text:
                self._current.append(text)
                # A linked headline inside an article is text.
                if (not links or headline and self._owner) and text.strip():
                    self._loose += len(text)
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if name == "a":
                links = 0 if closing else 1
                continue
            empty = name in VOID or attributes.endswith("/") and name not in OPEN
            if name in RAW and not closing and not empty:
                stop = -1 if name in endless else lower.find(f"</{name}", at)
                if stop >= 0:
                    at = stop
                else:
                    endless.add(name)
                    at = end if name in SWALLOWS else at
                self._end_line()
                continue
            block = name in BLOCK
            if block:
                self._end_line(config.window if name in PARTS and config.names or name in BODY and config.bounds else 0)
                links = 0 if loose_links else links
                headline = name in HEADLINES and not closing
                self._tag = "" if closing else name
            if closing:
                if self._open[name]:
                    while self._pop(self._stack[-1][0] == name) != name:
                        pass
                    if name in BODY and not any(self._open[x] for x in BODY):
                        self._owner = 0
            elif not empty:
                kind = _around(name, attributes, self._owner > 0) if config.names else 0
                around = Around(len(self.lines), kind == 2, self._owner, next((n for _, _, n in reversed(self._stack) if n), 0)) if kind else None
                if around:
                    if not block:
                        self._end_line()
                        around.start = len(self.lines)
                    self.arounds.append(around)
                if around or name in OPEN or self._named[name]:
                    self._push(name, around)
                if name in BODY and config.bounds and not self._owner:
                    self._owners += 1
                    self._owner = self._owners
        self._end_line()
        while self._stack:
            self._pop(False)


def block_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """For each line the sum of the weights of the ``window`` lines that end with it."""
    return np.convolve(weights, np.ones(window, weights.dtype))[: len(weights)]


def surges(sums: np.ndarray, thresholds: np.ndarray | float) -> list[tuple[int, int]]:
    """(surge, dive) points: the maximal runs of lines whose block sum is above its threshold."""
    up = np.diff(np.concatenate(([0], (sums > thresholds).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(up == 1).tolist(), np.flatnonzero(up == -1).tolist(), strict=True))


def _without_around(page: _Page, window: int) -> list[Line]:
    """The lines without elements around the article, found by the page's heaviest window."""
    lines = page.lines
    weights = np.array([x.weight * (_OWNED if x.owner else 1) for x in lines], float)
    for x in page.arounds:
        weights[x.start : x.stop if x.closed else x.direct] /= _DAMPED
    top = int(block_sums(weights, window).argmax())
    core = max(range(max(0, top - window + 1), top + 1), key=lambda i: weights[i])
    gone = np.zeros(len(lines), bool)
    own = lines[core]
    near = _density([x for x in lines if x.holder == own.holder and x.owner == own.owner]) / 2

    def prose(x: Around, part: list[Line]) -> bool:
        """Whether an element in the article's own container holds paragraphs nearly as dense as the article's."""
        beside = x.owner == own.owner and (x.owner > 0 or x.holder == own.holder)
        total = sum(line.weight for line in part)
        return beside and not x.certain and total > 0 and 2 * sum(line.weight for line in part if line.tag in TEXT) > total and _density(part) >= near

    for x in page.arounds:
        stop = x.stop if x.closed else x.direct
        if not x.start <= core < stop and not prose(x, lines[x.start : stop]):
            gone[x.start : stop] = [bool(line.text) for line in lines[x.start : stop]]
    return [line for line, g in zip(lines, gone.tolist(), strict=True) if not g]


def _density(lines: list[Line]) -> float:
    return sum(x.weight for x in lines) / max(1, sum(x.weight > 0 for x in lines))


def _trimmed(lines: list[Line], start: int, stop: int, window: int) -> tuple[int, int]:
    """The surge ``start`` to ``stop`` with the lighter text of its containers next to it, without what stands at its ends by chance."""
    holders = {x.holder for x in lines[start:stop] if x.weight}

    def next_to(x: Line) -> bool:
        return x.weight > 0 and not x.owner and (x.tag in HEADLINES or x.tag in TEXT and x.holder in holders)

    while start and next_to(lines[start - 1]):
        start -= 1
    while stop < len(lines) and next_to(lines[stop]):
        stop += 1
    part = lines[start:stop]
    total, light = sum(x.weight for x in part), _density(part) / 2
    title = next((i for i, x in enumerate(part) if x.tag == "h1"), 0)
    if title <= window and 4 * sum(x.weight for x in part[:title]) < total and not any(x.owner for x in part[:title]):
        start += title
    prose = 2 * sum(x.weight for x in part if x.tag in TEXT) > total

    def by_chance(x: Line) -> bool:
        return not x.owner and (not x.text or x.tag not in TEXT and (bool(_RIGHTS.search(x.text)) or prose and x.weight < light))

    while start < stop - 1 and by_chance(lines[start]):
        start += 1
    while start < stop - 1 and by_chance(lines[stop - 1]):
        stop -= 1
    return start, stop


def main_text(html: str | None, config: BlockConfig = BlockConfig()) -> str:
    """The article's text: blocks in page order, joined by one space; empty for null, empty or text-free pages."""
    if not html:
        return ""
    page = _Page(html, config)
    if not page.lines:
        return ""
    lines = _without_around(page, config.window)
    weights = np.array([x.weight for x in lines], float)
    if not weights.any():
        return " ".join(x.text for x in lines if x.text and x.owner)
    sums = block_sums(weights, config.window)
    least = config.threshold * sums[sums > 0].mean()
    found = surges(sums, np.where([x.owner > 0 for x in lines], 0.0, least))
    boosted = block_sums(np.array([x.weight * (_OWNED if x.owner else 1) for x in lines], float), config.window)
    core = int(boosted.argmax())
    first, last = next((a, b) for a, b in found if a <= core < b)
    owned = any(x.owner for x in lines[first:last])
    holders = {x.holder for x in lines[first:last] if x.weight}
    dense = config.density * _density(lines[first:last])
    kept = np.zeros(len(lines), bool)
    for start, stop in found:
        part = lines[start:stop]
        if owned:
            kept[start:stop] = [x.owner > 0 for x in part]
        elif start == first or holders & {x.holder for x in part if x.weight} or _density(part) >= dense:
            kept[slice(*_trimmed(lines, start, stop, config.window))] = True
    return " ".join(lines[i].text for i in np.flatnonzero(kept) if lines[i].text)


def extract(pages: DataFrame, config: BlockConfig = BlockConfig()) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty html, and one without text, gives an empty text. Repeated rows give repeated
    rows. Pages are handled one by one from start to end, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, config) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return small_batches(pages).mapInArrow(run, "page_id long, url string, text string, n_chars long")
