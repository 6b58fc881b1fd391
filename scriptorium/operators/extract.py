"""Readable text of raw web pages, its usability and its relevance to a query, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the extraction rules.
DROPPED = ("script", "style", "noscript", "svg", "head")
BLOCK_TAGS = "p|div|section|li|td|article|blockquote"
NOISE = "[¶§†‡•·]"
MIN_CHARS, MAX_CHARS, MIN_BLOCK = 200, 80_000, 30
MIN_VISIBLE, MAX_LINKS = 0.4, 0.5
GENERIC_WORDS = ("apache", "the", "and", "for", "with", "from", "that", "this", "are", "was")
ERROR_PAGES = (
    r"404|not found|page not found|页面不存在",
    r"captcha|验证码|security check|安全验证",
    r"access denied|access forbidden|403|access blocked",
    r"please enable javascript|请启用 javascript",
    r"too many requests|请求过于频繁",
    r"under maintenance|维护中",
)


def _plain(text: Column, tag: str) -> Column:
    """Tags to ``tag``, character references and noise glyphs to spaces, white space collapsed."""
    text = F.regexp_replace(text, r"<[^>]+>", tag)
    text = F.regexp_replace(text, r"&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;|" + NOISE, " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _dense(block: Column) -> Column:
    visible = F.length(F.regexp_replace(block, r"(?U)\s", "")) / F.greatest(F.length(block), F.lit(1))
    links = F.regexp_count(block, F.lit("https?://")) / F.greatest(F.floor(F.length(block) / 50), F.lit(1))
    return (F.length(block) >= MIN_BLOCK) & (visible >= MIN_VISIBLE) & (links <= MAX_LINKS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def page_text(html: Column) -> Column:
    """Dense blocks of the first article or main element, else of the page; the whole page's text if they hold too little."""
    body = r"(?is)<(article|main)[^>]*>(.*?)</\1>"
    dropped = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({'|'.join(DROPPED)})[^>]*>.*?</\1>", " ")

    def region(page: Column) -> Column:
        return _let(F.regexp_extract(page, body, 2), lambda found: F.when(found != "", found).when(page.rlike(body), "").otherwise(page))

    def dense(page: Column) -> Column:
        blocks = F.transform(F.split(region(page), f"(?i)</?(?:{BLOCK_TAGS})[^>]*>"), lambda b: _plain(b, ""))
        return F.array_join(F.filter(blocks, _dense), "\n")

    def text(page: Column) -> Column:
        whole = lambda short: _let(_plain(page, " "), lambda all_: F.when(F.length(all_) > F.length(short), all_).otherwise(short))
        return _let(dense(page), lambda found: F.when(F.length(found) >= MIN_CHARS, found).otherwise(whole(found)))

    return F.substring(_let(dropped, text), 1, MAX_CHARS)


def with_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text`` in place of ``html``.

    A generator makes the column, so filters and expressions over it don't hold the page's cleaning
    again: every page is cleaned once.
    """
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.explode(F.array(page_text(F.col(html)))).alias(text))


def usable(text: Column, query: str) -> Column:
    """Long enough, no error page, and at least one of the query's specific Latin words occurs."""
    ok = (F.length(text) >= MIN_CHARS) & ~text.rlike(f"(?i){'|'.join(ERROR_PAGES)}")
    words = dict.fromkeys(w.lower() for w in re.findall(r"[a-zA-Z]{3,}", query) if w.lower() not in GENERIC_WORDS)
    if words:
        ok &= F.lower(text).rlike("|".join(words))
    return F.coalesce(ok, F.lit(False))


def relevance(text: Column, query: str) -> Column:
    """Share of the query's distinct tokens of two letters or more that occur in the text."""
    tokens = sorted(set(re.findall(r"[\w一-鿿]{2,}", query.lower())))
    if not tokens:
        return F.lit(0.0)
    hits = sum((F.lower(text).contains(t).cast("int") for t in tokens), F.lit(0))
    return F.when(F.length(text) > 0, F.least(hits / F.lit(float(len(tokens))), F.lit(1.0))).otherwise(0.0)
