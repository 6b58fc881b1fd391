"""Queries of the search operators from raw lines and answers to ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import _clean_urls, _ROWS, _rows
from scriptorium.operators import build, search, serp
from scriptorium.registry import register
from scriptorium.tables import load

_BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
DEFAULT_QUERY = "apache kafka"


def _clean(x: str) -> str:
    x = _STRIP(x)
    for pattern, to in search.QUERY_MARKS:
        x = rf"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return _STRIP(x)


#: Each turn in the guise of a marked-up list item.
_MARKED = "CASE turn % 4 WHEN 0 THEN '1. **' || text || '** — x*y' WHEN 1 THEN '- *' || text || '* z' WHEN 2 THEN ' [t ' || text || ' [u]](http://a(b)) ' ELSE text || ' ——–' END"


@register(f"SELECT conv_id, turn, {_clean('m')} AS query FROM (SELECT conv_id, turn, {_MARKED} AS m FROM conversations)")
def query_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKED).alias("m"))
    return marked.select("conv_id", "turn", search.clean_query(F.col("m")).alias("query"))


_NOISE = "|".join(search.QUERY_NOISE)
_GUISED = "CASE WHEN doc_id % 5 = 0 THEN '# ' ELSE '' END || line"


@register(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
q AS (SELECT doc_id, pos, {_STRIP(_GUISED)} AS query FROM l), k AS (SELECT *, length(query) >= 4 AND NOT starts_with(query, '#') AND NOT regexp_matches(query, '(?i){_NOISE}') AS ok FROM q)
SELECT doc_id, pos::BIGINT AS pos, query FROM k WHERE ok UNION ALL SELECT doc_id, NULL, '{DEFAULT_QUERY}' FROM k GROUP BY doc_id HAVING NOT bool_or(ok)""")
def query_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of queries, one a line."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.expr(_GUISED))
    return search.queries_of(lines, "doc_id", "line", DEFAULT_QUERY).select("doc_id", F.col("pos").cast("long").alias("pos"), "query")


@register(rf"SELECT doc_id, substr(list_filter(list_transform(string_split(chr(10) || ' # note' || chr(10) || text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], 1, 80) AS topic FROM documents")
def topic_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", search.topic_line(F.concat(F.lit("\n # note\n"), "text")).alias("topic"))


#: Queries of the search rows: Chinese with a connector, stop words alone, Latin words, none.
_ASKED = "CASE pos % 4 WHEN 0 THEN '核心架构与生产实践系统 thtion' WHEN 1 THEN 'of the' WHEN 2 THEN 'apache thtion and there' ELSE '' END"
_TOKENS = rf"""list_filter(list_concat(list_filter(runs, lambda x: length(x) >= 2), flatten(list_transform(list_filter(runs, lambda x: length(x) > 4), lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))),
  regexp_extract_all(lower(query), '[a-z]{{2,}}')), lambda x: NOT list_contains({search.STOP_WORDS!r}, x))"""
_SCORED = rf"""
, asked AS (SELECT *, {_ASKED} AS query, lower(title || ' ' || snippet) AS body, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM rows),
toks AS (SELECT * EXCLUDE (runs), {_TOKENS} AS toks FROM (SELECT *, flatten(list_transform(regexp_extract_all(query, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda r: regexp_split_to_array(r, '{search.CONNECTORS}'))) AS runs FROM asked)),
rel AS (SELECT *, CASE WHEN len(toks) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(toks, lambda t: contains(body, t))) / len(toks)::DOUBLE END AS relevance FROM toks),
scored AS (SELECT *, least(1.0::DOUBLE, 0.35::DOUBLE * greatest(0, CASE WHEN length(title) BETWEEN 10 AND 120 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN length(snippet) > 50 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN source IN ('bing', 'sogou', '360', 'prosearch') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN starts_with(url, 'http') THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN contains(host, 'blog.') THEN 0.2::DOUBLE ELSE 0 END) + 0.65::DOUBLE * relevance) AS score FROM rel
  WHERE NOT ({' OR '.join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in search.SPAM_HOSTS)}) AND NOT ({' OR '.join(f"contains(lower(url), '{p}')" for p in search.TRACKING_PARTS)}) AND regexp_matches(title, '[\x{{4e00}}-\x{{9fff}}]{{2,}}|[a-zA-Z]{{3,}}'))
"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).withColumn("query", F.expr(_ASKED))


@register(_ROWS + _SCORED + "SELECT pos, round(relevance, 6) AS relevance, round(score, 6) AS score FROM scored")
def search_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All search rows that pass the filters, scored by their own query."""
    return search.scored(_asked(spark, sf_dir), ("blog.",)).select("pos", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


@register(_ROWS + _SCORED + f""", a AS (SELECT *, row_number() OVER (PARTITION BY split_part(clean, '?', 1) ORDER BY score DESC, pos) AS n FROM ({_clean_urls('(SELECT * FROM scored WHERE score >= 0.25 AND relevance > 0)')})),
b AS (SELECT *, left(lower({_STRIP('title')}), 30) AS t FROM a WHERE n = 1), c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, pos) AS m FROM b)
SELECT pos, url, round(score, 6) AS score FROM c WHERE m = 1 OR t = '' ORDER BY c.score DESC, pos LIMIT 50""")
def search_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw rows to the fifty best (a top-k report)."""
    return search.best_rows(_asked(spark, sf_dir), low_quality=("blog.",)).select("pos", "url", F.round("score", 6).alias("score"))


@register("""WITH r AS (SELECT page_id % 300 AS query, page_id, 'manager' AS engine FROM pages WHERE page_id % 300 > page_id / 8), e AS (SELECT query FROM r GROUP BY query HAVING count(*) >= 2)
SELECT query, page_id, engine FROM r UNION ALL SELECT DISTINCT page_id % 300, -1, engine FROM pages, (VALUES ('bing'), ('mock')) t(engine) WHERE page_id % 300 NOT IN (SELECT query FROM e)""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines of their own for queries that the manager answers less than twice."""
    asked = load(spark, sf_dir, "pages").select((F.col("page_id") % 300).alias("query"), "page_id")
    rows = asked.filter("query > page_id / 8").withColumn("engine", F.lit("manager"))
    builtin = asked.select("query").distinct().select("query", F.lit(-1).cast("long").alias("page_id"), F.explode(F.array(F.lit("bing"), F.lit("mock"))).alias("engine"))
    return search.with_fallback(rows, builtin, "query", 2).select("query", F.col("page_id").cast("long").alias("page_id"), "engine")


# -- result pages and answers ------------------------------------------------------------------

#: For each engine, a result page of one row and of rows that don't count.
_SERPS = {
    "bing": """'<ol><li class="b_algo"><h2><a href="' || url || '">' || title || ' <b>x</b></a></h2><p>' || snippet || '</p></li><li class="b_algo">none</li></ol>'""",
    "sogou": """'<div class="vrwrap"><h3><a class="t" href="' || url || '">' || title || ' <b>x</b></a></h3><p>no</p><p class="str-text-info">' || snippet || '</p></div> </div>'""",
    "360": """'<ul><li class="res-list"><a href="' || url || '">' || title || ' <b>x</b></a><p class="d">' || snippet || '</p></li></ul>'""",
    "baidu": """'<div class="result c" id="1"><a href="' || url || '">' || title || ' <b>x</b></a><span class="content-right_1a">' || snippet || '</span></div></div><div class="c-container"><a href="' || url || '">again</a></div> </div>'""",
    "duckduckgo": """'<a rel="n" class="result__a" href="//d.com/l/?uddg=' || replace(replace(url, '?', '%3F'), '&', '%26') || '&x=1">' || title || ' <b>x</b></a> <a class="result__snippet" href="z">' || snippet || '</a>'""",
}
_SHORT = "SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(substr(regexp_replace(html, '<[^>]+>', ' '{}), 1, 80)) AS snippet FROM {}"


@register(f"WITH s AS ({_SHORT.format(', ' + repr('g'), 'pages')}) SELECT page_id, engine, url, title || ' x' AS title, snippet FROM s, (VALUES {', '.join(f'({e!r})' for e in _SERPS)}) t(engine)")
def serp_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of five engines' result pages, made of each page's URL, title and beginning."""
    short = load(spark, sf_dir, "pages").selectExpr("page_id", "url", "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title", "trim(substring(regexp_replace(html, '<[^>]+>', ' '), 1, 80)) AS snippet")
    pages = short.select("page_id", *(F.expr(x).alias(f"serp_{e}") for e, x in _SERPS.items()))
    row = lambda e: lambda r: F.struct(F.lit(e).alias("engine"), r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"))
    parsed = [F.transform(serp.duck_rows(F.col(f"serp_{e}")) if e == "duckduckgo" else serp.block_rows(F.col(f"serp_{e}"), e), row(e)) for e in _SERPS]
    return pages.select("page_id", F.inline(F.concat(*parsed)))


@register(f"""WITH s AS ({_SHORT.format(', ' + repr('g'), 'pages')})
SELECT page_id, engine, url, title, snippet, 0::DOUBLE AS score FROM s, (VALUES ('metaso'), ('bocha'), ('tavily'), ('serper')) t(engine) UNION ALL SELECT page_id, 'serper', url, 'card', 'about', 1::DOUBLE FROM s WHERE page_id % 2 = 0""")
def search_api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of four search APIs' answers, made of each page's URL, title and beginning."""
    short = load(spark, sf_dir, "pages").selectExpr("page_id", "url", "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title", "trim(substring(regexp_replace(html, '<[^>]+>', ' '), 1, 80)) AS snippet")
    json = {
        "metaso": "named_struct('data', named_struct('webpages', named_struct('list', array(named_struct('title', title, 'link', url, 'snippet', snippet)))))",
        "bocha": "named_struct('data', named_struct('webPages', named_struct('value', array(named_struct('name', title, 'url', url, 'summary', '', 'snippet', snippet)))))",
        "tavily": "named_struct('results', array(named_struct('title', title, 'url', url, 'content', snippet)))",
        "serper": "named_struct('organic', array(named_struct('title', title, 'link', url, 'snippet', snippet)), 'knowledgeGraph', if(page_id % 2 = 0, named_struct('title', 'card', 'website', url, 'description', 'about'), NULL))",
    }
    answers = short.select("page_id", *(F.expr(f"to_json({x})").alias(e) for e, x in json.items()))
    row = lambda e: lambda r: F.struct(F.lit(e).alias("engine"), r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"), (r["score"] if e == "serper" else F.lit(0.0)).alias("score"))
    parsed = [F.transform(serp.serper_rows(F.col(e)) if e == "serper" else serp.api_rows(F.col(e), e), row(e)) for e in json]
    return answers.select("page_id", F.inline(F.concat(*parsed)))


#: Links of each page made absolute, with a name in every other.
_LINKED = "replace(replace(html, 'href=\"/', 'href=\"https://site.example/'), '<li><a href=\"https://site.example/th', '<li title=\"named <i>link</i>\"><a href=\"https://site.example/th')"


@register(rf"""WITH h AS (SELECT page_id, {_LINKED} AS html FROM pages), u AS (SELECT page_id, html, unnest(regexp_extract_all(html, '{serp.LINK}')) AS hit, unnest(regexp_split_to_array(html, '{serp.LINK}')) AS piece, unnest(range(len(regexp_extract_all(html, '{serp.LINK}')) + 1)) AS pos FROM h),
p AS (SELECT page_id, pos, html, hit, regexp_extract(hit, '{serp.LINK}', 1) AS url, sum(length(piece)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM u WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n, regexp_extract(substr(html, greatest(ofs - 200, 0)::BIGINT + 1, (least(ofs, 200) + length(hit))::BIGINT), '(?:title|aria-label)="([^"]+)"', 1) AS named FROM p WHERE hit IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM f WHERE n = 1 AND NOT regexp_matches(url, '\.(css|js|svg|png|ico)$') AND NOT regexp_matches(url, 'google\.com|bing\.com|sogou\.com|so\.com'))
SELECT page_id, pos::BIGINT AS pos, url, left({_STRIP("regexp_replace(CASE WHEN named <> '' THEN named ELSE left(string_split(url, '/')[-1], 60) END, '<[^>]+>', '', 'g')")}, 120) AS title,
 left({_STRIP("regexp_replace(substr(html, (ofs + length(hit))::BIGINT + 1, 500), '<[^>]+>', '', 'g')")}, 200) AS snippet FROM g WHERE k <= 10""")
def serp_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of any page with the text around them."""
    return serp.context_rows(load(spark, sf_dir, "pages").select("page_id", F.expr(_LINKED).alias("html")), "page_id", "html")


@register("""WITH a AS (SELECT page_id % 20 AS task, page_id, split_part(url, '/', 3) AS url, page_id % 7 AS relevance FROM pages), b AS (SELECT *, row_number() OVER (PARTITION BY task, url ORDER BY relevance DESC, page_id) AS n FROM a)
SELECT task, page_id, row_number() OVER (PARTITION BY task ORDER BY relevance DESC, page_id) AS place FROM b WHERE n = 1 OR url = ''""")
def article_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of twenty tasks by relevance, each host once, with their places."""
    rows = load(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("task"), "page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("url"), (F.col("page_id") % 7).alias("relevance"))
    return build.ordered_articles(rows, "page_id").select("task", "page_id", "place")
