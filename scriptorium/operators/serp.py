"""Result rows out of search pages and search API answers, as Column expressions over arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.tables import newest, small_batches

# Where each engine's page or answer holds its rows.
ANCHOR = r'(?s)<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>'
BLOCKS = {
    "bing": (r'(?s)<li class="b_algo">(.*?)</li>', r"(?s)<p[^>]*>(.*?)</p>"),
    "sogou": (r'(?s)<div class="vrwrap">(.*?)</div>\s*</div>', r'(?s)<p[^>]*class="str-text-info"[^>]*>(.*?)</p>'),
    "360": (r'(?s)<li class="res-list">(.*?)</li>', r"(?s)<p[^>]*>(.*?)</p>"),
    "baidu": (r'(?s)<div class="(?:result|c-container)[^"]*"[^>]*>(.*?)</div>\s*</div>', r'(?s)<span[^>]*class="content-right_[^"]*"[^>]*>(.*?)</span>'),
}
LINK = r'<a[^>]+href="(https?://[^"]+)"[^>]*>'
ASSETS = (".css", ".js", ".svg", ".png", ".ico")
DUCK = r'(?s)<a[^>]+class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>.*?class="result__snippet"[^>]*>(.*?)</a>'
OWN_HOSTS = ("google.com", "bing.com", "sogou.com", "so.com")
API_ROWS = {"metaso": "$.data.webpages", "bocha": "$.data.webPages.value", "tavily": "$.results", "serper": "$.organic"}
API_FIELDS = {"title": ("title", "name"), "url": ("url", "link"), "snippet": ("summary", "snippet", "description", "content")}


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, url, title): links with a title of five letters or more that leave the search site, first of each URL."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), 0)).alias("pos", "hit"))
    found = found.select(key, "pos", F.regexp_extract("hit", ANCHOR, 1).alias("url"), plain(F.regexp_extract("hit", ANCHOR, 2)).alias("title"))
    own = F.lit(False)
    for host in OWN_HOSTS:
        own |= F.col("url").contains(host)
    found = found.filter((F.length("title") >= 5) & ~own)
    return newest(found, [key, "url"], ["pos"], 1)


def block_rows(html: Column, engine: str, most: int = 10) -> Column:
    """array<struct<url, title, snippet>> of the first ``most`` blocks of an engine's page that hold a link with a title; Baidu's links once each."""
    block, snippet = BLOCKS[engine]
    found = F.slice(F.regexp_extract_all(html, F.lit(block), 1), 1, most)
    rows = F.transform(found, lambda b: F.struct(F.regexp_extract(b, ANCHOR, 1).alias("url"), plain(F.regexp_extract(b, ANCHOR, 2)).alias("title"), plain(F.regexp_extract(b, snippet, 1)).alias("snippet")))
    if engine == "baidu":
        urls = F.transform(rows, lambda r: r["url"])
        rows = F.filter(rows, lambda r, i: F.array_position(urls, r["url"]) == i + 1)
    return F.filter(rows, lambda r: (r["url"] != "") & (r["title"] != ""))


def bing_rows(html: Column) -> Column:
    return block_rows(html, "bing")


def duck_rows(html: Column) -> Column:
    """As bing_rows; a redirect's target is its ``uddg`` parameter, decoded."""
    hits = F.regexp_extract_all(html, F.lit(DUCK), 0)

    def row(x: Column) -> Column:
        link = F.regexp_extract(x, DUCK, 1)
        target = F.regexp_extract(link, "uddg=([^&]+)", 1)
        return F.struct(F.when(target != "", F.try_url_decode(target)).otherwise(link).alias("url"), plain(F.regexp_extract(x, DUCK, 2)).alias("title"), plain(F.regexp_extract(x, DUCK, 3)).alias("snippet"))

    return F.filter(F.transform(hits, row), lambda r: (r["url"] != "") & (r["title"] != ""))


def api_rows(answer: Column, engine: str) -> Column:
    """array<struct<url, title, snippet>> of a JSON answer; null where it isn't JSON or has no rows."""
    at = F.get_json_object(answer, API_ROWS[engine])
    if engine == "metaso":
        at = F.coalesce(F.get_json_object(at, "$.list"), at)
    items = F.from_json(at, "array<map<string,string>>")
    first = lambda m, names: F.coalesce(*(F.nullif(m[n], F.lit("")) for n in names), F.lit(""))
    return F.transform(items, lambda m: F.struct(*(first(m, API_FIELDS[k]).alias(k) for k in ("url", "title", "snippet"))))


def serper_rows(answer: Column, most: int = 10) -> Column:
    """array<struct<url, title, snippet, score>> of a Serper answer; a titled knowledge card is the first row, with score 1."""
    card = "$.knowledgeGraph."
    get = lambda field: F.coalesce(F.get_json_object(answer, card + field), F.lit(""))
    first = F.struct(get("website").alias("url"), get("title").alias("title"), get("description").alias("snippet"), F.lit(1.0).alias("score"))
    rows = F.transform(F.slice(F.coalesce(api_rows(answer, "serper"), F.array().cast("array<struct<url:string,title:string,snippet:string>>")), 1, most), lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"), F.lit(0.0).alias("score")))
    return F.when(get("title") != "", F.concat(F.array(first), rows)).otherwise(rows)


def _around_links(html: str | None, skip: tuple[str, ...], most: int) -> list[tuple[int, str, str, str]]:
    """(pos, url, title, snippet) of the first link of each URL, from 200 characters before it and 500 behind it."""
    found, seen = [], set()
    for pos, m in enumerate(re.finditer(LINK, html or "")):
        url = m[1]
        if url in seen:
            continue
        seen.add(url)
        if any(x in url for x in skip) or url.endswith(ASSETS):
            continue
        named = re.search(r'(?:title|aria-label)="([^"]+)"', html[max(0, m.start() - 200) : m.end()])
        title = re.sub("<[^>]+>", "", named[1] if named else url.split("/")[-1][:60]).strip()[:120]
        found.append((pos, url, title, re.sub("<[^>]+>", "", html[m.end() : m.end() + 500]).strip()[:200]))
        if len(found) == most:
            break
    return found


def context_rows(pages: DataFrame, key: str, html: str, skip: tuple[str, ...] = OWN_HOSTS, most: int = 10) -> DataFrame:
    """(key, pos, url, title, snippet): links of any result page with their title from the tag or the text before it, their snippet from the text behind."""
    hit = pa.list_(pa.struct([("pos", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("snippet", pa.string())]))
    names = ("pos", "url", "title", "snippet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(names, r, strict=True)) for r in _around_links(x, skip, most)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, hit)], names=[key, "hits"])

    schema = pages.select(key).withColumn("hits", F.lit(None).cast("array<struct<pos: long, url: string, title: string, snippet: string>>")).schema
    return small_batches(pages.select(key, html)).mapInArrow(run, schema).select(key, F.inline("hits"))
