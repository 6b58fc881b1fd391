"""Page text by the tree of elements: a parser of the standard library, one Arrow pass a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.extract import MAX_CHARS, MAX_LINKS, MIN_BLOCK, MIN_CHARS, MIN_VISIBLE, NOISE
from scriptorium.tables import small_batches

# Elements without text of a page, and elements that hold blocks of it.
DROPPED = frozenset(("script", "style", "noscript", "svg", "head", "nav", "footer", "aside"))
BLOCKS = frozenset("p div section li td blockquote article h1 h2 h3 h4 pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Pieces(HTMLParser):
    """A page's pieces of text in order, and for each element the range of pieces inside it. A ``p`` ends where a block begins."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.pieces: list[str] = []
        self.elements: list[tuple[str, int, int]] = []
        self._open: list[tuple[str, int]] = []
        self._dropped = 0
        self.feed(html)
        self.close()
        self._close(0)

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            name, at = self._open.pop()
            self._dropped -= name in DROPPED
            number, start = at, self.elements[at][1]
            self.elements[number] = (name, start, len(self.pieces))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if tag in BLOCKS:
            # Inline elements that are still open inside the paragraph end with it.
            at = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] in BLOCKS), None)
            if at is not None and self._open[at][0] == "p":
                self._close(at)
        self.elements.append((tag, len(self.pieces), -1))
        self._open.append((tag, len(self.elements) - 1))
        self._dropped += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == tag), None)
        if at is not None:
            self._close(at)

    def handle_data(self, data: str) -> None:
        if not self._dropped and (bare := data.strip()):
            self.pieces.append(bare)


def _dense(block: str) -> bool:
    visible = len(re.sub(r"\s", "", block)) / max(len(block), 1)
    return len(block) >= MIN_BLOCK and visible >= MIN_VISIBLE and len(re.findall("https?://", block)) / max(len(block) // 50, 1) <= MAX_LINKS


def dom_text(html: str | None) -> str:
    """Dense blocks of the first article, else main element, else the page, each as a line, blocks inside blocks too; the whole text if they hold too little."""
    if not html:
        return ""
    page = _Pieces(html)
    bounds = next(((a, b) for name in ("article", "main") for n, a, b in page.elements if n == name), (0, len(page.pieces)))
    inside = [(n, a, b) for n, a, b in page.elements if n in BLOCKS and bounds[0] <= a and b <= bounds[1] and not (n in ("article", "main") and (a, b) == bounds)]
    text = "\n".join(t for _, a, b in inside if _dense(t := " ".join(page.pieces[a:b])))
    if len(text) < MIN_CHARS:
        whole = re.sub(r"\s+", " ", re.sub(NOISE, " ", " ".join(page.pieces))).strip()
        text = whole if len(whole) > len(text) else text
    return text[:MAX_CHARS]


def with_dom_text(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, text) of each page; null and empty pages have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(dom_text, batch.column(1).to_pylist()), pa.string())], names=[key, "text"])

    return small_batches(pages.select(key, F.col(html).cast("string"))).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")
