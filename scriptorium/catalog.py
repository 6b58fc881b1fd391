"""All registered queries and their oracle SQL. Each query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import convert, enhance, extract, layout, quality, rank, search, serp, writer
from scriptorium.streaming import control
from scriptorium.registry import oracle_sql, queries, register as _register  # noqa: F401
from scriptorium.tables import load, spread

TOPIC = "apache kafka there edtion"
KEYWORDS = ["the", "and", "thtion", "ered", "onea"]

# -- pages -------------------------------------------------------------------------------------

_WHITE = r"[\s\x0b\p{Z}]"


def _sql_plain(x: str, tag: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '{tag}', 'g'), '&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;|[¶§†‡•·]', ' ', 'g'), '{_WHITE}+', ' ', 'g'))"""


def _sql_dropped(x: str) -> str:
    for name in extract.DROPPED:
        x = rf"regexp_replace({x}, '(?is)<{name}[^>]*>.*?</{name}>', ' ', 'g')"
    return x


_TEXTS = rf"""
WITH a AS (SELECT page_id, url, {_sql_dropped("coalesce(html, '')")} AS h FROM pages),
b AS (SELECT *, CASE WHEN regexp_matches(h, '(?is)<article[^>]*>.*?</article>') THEN regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1)
                     WHEN regexp_matches(h, '(?is)<main[^>]*>.*?</main>') THEN regexp_extract(h, '(?is)<main[^>]*>(.*?)</main>', 1) ELSE h END AS region FROM a),
c AS (SELECT page_id, url, h, list_transform(regexp_split_to_array(region, '(?i)</?(?:{extract.BLOCK_TAGS})[^>]*>'), lambda x: {_sql_plain("x", "")}) AS blocks FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: length(x) >= 30 AND length(regexp_replace(x, '{_WHITE}', '', 'g')) / greatest(length(x), 1) >= 0.4
        AND len(regexp_extract_all(x, 'https?://')) / greatest(length(x) // 50, 1) <= 0.5), chr(10)) AS t, {_sql_plain("h", " ")} AS w FROM c),
texts AS (SELECT page_id, url, substr(CASE WHEN length(t) < 200 AND length(w) > length(t) THEN w ELSE t END, 1, 80000) AS text FROM d)
"""
_ERRORS = " AND ".join(f"NOT regexp_matches(text, '(?i){p}')" for p in extract.ERROR_PAGES)
_TOPIC_WORDS = [w for w in TOPIC.split() if w not in extract.GENERIC_WORDS]
_USABLE = f"(length(text) >= 200 AND {_ERRORS} AND ({' OR '.join(f'contains(lower(text), {w!r})' for w in _TOPIC_WORDS)}))"
_RELEVANCE = "(CASE WHEN length(text) > 0 THEN least((" + " + ".join(f"contains(lower(text), {w!r})::INT" for w in sorted(set(TOPIC.split()))) + f") / {len(set(TOPIC.split()))}.0, 1.0) ELSE 0.0 END)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_text(spread(load(spark, sf_dir, "pages").select("page_id", "url", "html")))


@_register(_TEXTS + "SELECT page_id, text, length(text)::BIGINT AS n_chars FROM texts")
def page_extract_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@_register(_TEXTS + f"SELECT page_id FROM texts WHERE {_USABLE}")
def page_usable_filter(spark, sf_dir):
    return _texts(spark, sf_dir).filter(extract.usable(F.col("text"), TOPIC)).select("page_id")


@_register(_TEXTS + f"SELECT page_id, round({_RELEVANCE}, 3)::DOUBLE AS relevance FROM texts")
def page_content_relevance(spark, sf_dir):
    return _texts(spark, sf_dir).select("page_id", F.round(extract.relevance(F.col("text"), TOPIC), 3).alias("relevance"))


@_register(_TEXTS + f"SELECT page_id, url, round({_RELEVANCE}, 3)::DOUBLE AS relevance, length(text)::BIGINT AS n_chars FROM texts WHERE {_USABLE} ORDER BY relevance DESC, page_id LIMIT 20")
def page_extract_rank(spark, sf_dir):
    """The 20 most relevant usable pages."""
    kept = _texts(spark, sf_dir).filter(extract.usable(F.col("text"), TOPIC))
    return kept.select("page_id", "url", F.round(extract.relevance(F.col("text"), TOPIC), 3).alias("relevance"), F.length("text").cast("long").alias("n_chars")).orderBy(F.desc("relevance"), "page_id").limit(20)


@_register(_TEXTS + f"SELECT count(*)::BIGINT AS attempted, count(*) FILTER ({_USABLE})::BIGINT AS success, count(*) FILTER (NOT {_USABLE})::BIGINT AS filtered FROM texts")
def fetch_stats(spark, sf_dir):
    ok = extract.usable(F.col("text"), TOPIC)
    return _texts(spark, sf_dir).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("filtered"))


# -- search rows -------------------------------------------------------------------------------

_ROWS = r"""
WITH rows AS (SELECT page_id AS pos, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, substr(regexp_replace(html, '<[^>]+>', ' ', 'g'), 1, 200) AS snippet,
  CASE page_id % 4 WHEN 0 THEN 'bing' WHEN 1 THEN 'sogou' WHEN 2 THEN 'mock' ELSE '360' END AS source FROM pages)
"""
_PARAMS = ", ".join(f"'{p}'" for p in search.TRACKING_PARAMS)
_DECODED = "url_decode(replace({}, '+', ' '))".format
_PARTS = rf"""list_filter(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
  lambda p: {{'n': {_DECODED("split_part(p, '=', 1)")}, 'v': {_DECODED("regexp_extract(p, '^[^=]*=(.*)$', 1)")}}}), lambda x: lower(x.n) NOT IN ({_PARAMS}))"""
_NORMAL = """regexp_replace(regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END || regexp_extract(url, '(#.*)$', 1), '[?&]+$', '')"""


def _clean_urls(table: str) -> str:
    return f"SELECT *, {_NORMAL} AS clean FROM (SELECT *, array_to_string(list_transform({_PARTS}, lambda x: x.n || '=' || x.v), '&') AS q FROM {table})"


_NORMALIZED = f"SELECT page_id, clean AS url FROM ({_clean_urls('pages')})"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("bing", "sogou", "mock", "360"))), (F.col("page_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.substring(F.regexp_replace("html", "<[^>]+>", " "), 1, 200).alias("snippet"), source.alias("source"))


@_register(_NORMALIZED)
def url_normalize(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", search.normalize_url(F.col("url")).alias("url"))


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


@_register(_ROWS + f"SELECT pos, url FROM rows WHERE NOT ({' OR '.join(f'{_HOST} = {h!r} OR ends_with({_HOST}, {chr(39)}.{h}{chr(39)})' for h in search.SPAM_HOSTS)})")
def spam_anti_join(spark, sf_dir):
    return search.without_spam(_rows(spark, sf_dir)).select("pos", "url")


@_register(_ROWS + f"SELECT pos, ({' OR '.join(f'contains(lower(url), {p!r})' for p in search.TRACKING_PARTS)}) AS tracked, regexp_matches(title, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-zA-Z]{{3,}}') AS readable FROM rows")
def tracking_and_title_filters(spark, sf_dir):
    return _rows(spark, sf_dir).select("pos", search.tracking(F.col("url")).alias("tracked"), search.readable_title(F.col("title")).alias("readable"))


_STRUCT = "(CASE WHEN length(title) BETWEEN 10 AND 120 THEN 0.15 ELSE 0 END + CASE WHEN length(snippet) > 50 THEN 0.15 ELSE 0 END + CASE WHEN source IN ('bing', 'sogou', '360', 'prosearch') THEN 0.1 ELSE 0 END + CASE WHEN starts_with(url, 'http') THEN 0.1 ELSE 0 END)::DOUBLE"
_SEARCH_RELEVANCE = _RELEVANCE.replace("text", "body").replace("/ 4.0", "/ 4.0::DOUBLE")


@_register(_ROWS + f"SELECT pos, round(least(1.0, 0.35::DOUBLE * {_STRUCT} + 0.65::DOUBLE * {_SEARCH_RELEVANCE}), 6)::DOUBLE AS score FROM (SELECT *, title || ' ' || snippet AS body FROM rows)")
def search_score(spark, sf_dir):
    related = extract.relevance(F.concat_ws(" ", "title", "snippet"), TOPIC)
    structure = search.structural_score(*map(F.col, ("title", "url", "snippet", "source")))
    return _rows(spark, sf_dir).select("pos", F.round(search.blended_score(structure, related), 6).alias("score"))


@_register(_ROWS + f", a AS (SELECT *, row_number() OVER (PARTITION BY split_part(clean, '?', 1) ORDER BY pos) AS n FROM ({_clean_urls('rows')})), b AS (SELECT *, left(lower(trim(title)), 30) AS t FROM a WHERE n = 1), c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY pos) AS m FROM b) SELECT pos, url FROM c WHERE m = 1 OR t = ''")
def search_dedup(spark, sf_dir):
    return search.first_of_each(_rows(spark, sf_dir)).select("pos", "url")


@_register("""SELECT conv_id, turn, engine, 0.5::DOUBLE AS score, 'https://example.com/search?q=' || text AS url FROM conversations, (VALUES ('bing'), ('sogou')) e(engine) WHERE role = 'user'""")
def mock_search(spark, sf_dir):
    asked = load(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.explode(F.array(F.lit("bing"), F.lit("sogou"))).alias("engine"), F.lit(0.5).alias("score"), F.concat(F.lit("https://example.com/search?q="), "text").alias("url"))


_NOISE_SQL = " AND ".join(f"NOT regexp_matches(trim(text), '(?i){p}')" for p in search.QUERY_NOISE)


@_register(f"SELECT conv_id, turn, trim(text) AS query FROM conversations WHERE role = 'user' AND length(trim(text)) >= 4 AND regexp_matches(trim(text), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-zA-Z]{{2,}}') AND {_NOISE_SQL}")
def query_clean(spark, sf_dir):
    return load(spark, sf_dir, "conversations").filter((F.col("role") == "user") & search.usable_query(F.col("text"))).select("conv_id", "turn", search.trimmed(F.col("text")).alias("query"))


# -- ranking -----------------------------------------------------------------------------------

_KEYS = ", ".join(f"'{k}'" for k in KEYWORDS)


@_register(rf"""
WITH p AS (SELECT doc_id * 2147483648 + i AS para_id, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
t AS (SELECT para_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]{{2,}}')) AS term FROM p),
tf AS (SELECT para_id, term, count(*) AS n FROM t GROUP BY ALL), tm AS (SELECT *, n / max(n) OVER (PARTITION BY para_id) AS tf FROM tf),
df AS (SELECT term, ln(((SELECT count(DISTINCT para_id) FROM p) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT para_id, tm.term, tf * idf AS w FROM tm JOIN df USING (term)),
s AS (SELECT para_id, sum(CASE WHEN term IN ({_KEYS}) THEN w ELSE 0 END) / (sqrt(sum(w * w)) * sqrt({len(KEYWORDS)}.0::DOUBLE)) AS score FROM w GROUP BY para_id)
SELECT para_id, round(score, 6) AS score FROM s WHERE score > 0.01 ORDER BY score DESC, para_id LIMIT 8""")
def tfidf_top8(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    # A document's lines are fewer than its characters, and Parquet holds less than 2^31 of these.
    return rank.rank(docs.select((F.col("doc_id") * 2**31 + F.col("i")).alias("para_id"), "text"), KEYWORDS)


# -- documents as Markdown ---------------------------------------------------------------------

_MD = """
WITH md AS (SELECT doc_id, '# ' || source || ' ' || doc_id || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || chr(10) || '## 目录' ELSE '' END || chr(10) || chr(10)
  || CASE doc_id % 4 WHEN 0 THEN '## Part' WHEN 1 THEN '### Deep' WHEN 2 THEN '- item' ELSE '> quote' END || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))
  || CASE WHEN doc_id % 5 = 0 THEN repeat(chr(10), 7) || 'after blanks' ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## 参考资料' || chr(10) || '[a](https://example.com/' || doc_id || ') [b]() [c](ftp://x)' ELSE '' END AS text FROM documents)
"""


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    nn = F.lit("\n\n")
    part = F.element_at(F.array(*map(F.lit, ("## Part", "### Deep", "- item", "> quote"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(
        F.lit("# "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 != 0, "\n\n## 目录").otherwise(""), nn, part, nn, F.replace(F.col("text"), F.lit("\n"), nn),
        F.when(F.col("doc_id") % 5 == 0, "\n" * 7 + "after blanks").otherwise(""),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n\n## 参考资料\n[a](https://example.com/"), F.col("doc_id").cast("string"), F.lit(") [b]() [c](ftp://x)"))).otherwise(""),
    )
    return docs.select("doc_id", text.alias("text"))


_PARAS = "len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(trim(p)) > 30))"
_LEVELS = r"list_transform(regexp_extract_all(text, '(?m)^(#+)\s', 1), lambda x: length(x))"
_SCORES = rf"""
, s AS (SELECT doc_id,
 greatest(0, 100 - CASE WHEN regexp_matches(text, '(?m)^#\s') THEN 0 ELSE 25 END - CASE WHEN contains(text, '## 目录') OR contains(left(text, 500), '目录') THEN 0 ELSE 15 END
   - CASE WHEN regexp_matches(text, '(?m)^## 参考') THEN 0 ELSE 20 END - 20 * greatest(0, 3 - {_PARAS})) AS completeness,
 CASE WHEN len(lv) = 0 THEN 30 ELSE greatest(0, 100 - CASE len(list_filter(lv, lambda x: x = 1)) WHEN 0 THEN 20 WHEN 1 THEN 0 ELSE 10 END
   - 5 * len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] - lv[i - 1] > 1)) - 15 * greatest(0, 2 - len(list_filter(lv, lambda x: x = 2)))) END AS structure,
 greatest(0, 100 - 2 * len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 120)) - CASE WHEN contains(text, '```') OR contains(text, '> ') THEN 0 ELSE 10 END - CASE WHEN contains(text, '- ') OR contains(text, '* ') THEN 0 ELSE 5 END) AS readability,
 CASE WHEN len(lk) = 0 THEN 50 ELSE greatest(0, 100 - list_sum(list_transform(lk, lambda u: CASE WHEN trim(u) = '' THEN 15 WHEN starts_with(u, 'https://example.com') THEN 10 WHEN NOT (starts_with(u, 'http') OR starts_with(u, '#')) THEN 5 ELSE 0 END))) END AS citation,
 CASE WHEN {_PARAS} < 3 THEN least(40, d) ELSE d END AS depth
FROM (SELECT *, {_LEVELS} AS lv, regexp_extract_all(text, '\[[^\]]*\]\(([^)]*)\)', 1) AS lk, CASE WHEN length(text) < 200 THEN 30 WHEN length(text) < 500 THEN 50 WHEN length(text) < 1000 THEN 70 WHEN length(text) > 5000 THEN 95 ELSE 100 END AS d FROM md))
"""


def _score_query(name: str) -> None:
    def run(spark, sf_dir):
        return _md(spark, sf_dir).select("doc_id", getattr(quality, name)(F.col("text")).cast("long").alias("score"))

    run.__name__ = f"score_{name}"
    _register(_MD + _SCORES + f"SELECT doc_id, {name}::BIGINT AS score FROM s")(run)


for _name in ("completeness", "structure", "readability", "citation", "depth"):
    _score_query(_name)


@_register(_MD + _SCORES + "SELECT doc_id, round((0.18::DOUBLE * completeness + 0.12::DOUBLE * structure + 0.10::DOUBLE * readability + 0.12::DOUBLE * citation + 0.10::DOUBLE * depth) / 0.62::DOUBLE, 1) >= 70 AS passed FROM s")
def quality_gate(spark, sf_dir):
    return quality.with_overall(_md(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", (F.col("overall") >= quality.THRESHOLD).alias("passed"))


_LINES = ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM md)"


@_register(_MD + _LINES + ", g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l), h AS (SELECT *, max(island) OVER (PARTITION BY doc_id) AS m FROM g) SELECT doc_id, min(line_no)::BIGINT AS line_no, count(*)::BIGINT AS run FROM h WHERE trim(line) = '' AND island < m GROUP BY doc_id, island HAVING count(*) >= 5")
def lint_blank_runs(spark, sf_dir):
    return layout.blank_runs(_md(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run")


@_register(_MD + _LINES + r", g AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) AS level FROM l), h AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM g WHERE level > 0) SELECT doc_id, line_no::BIGINT AS line_no, level::BIGINT AS level, b::BIGINT AS before FROM h WHERE level - b > 1")
def lint_heading_gap(spark, sf_dir):
    return layout.heading_gaps(_md(spark, sf_dir)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line_no", "level", "before")))


_SECTIONS = _LINES + r", g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_no FROM l), sec AS (SELECT doc_id, sec_no::BIGINT AS sec_no, min(line_no)::BIGINT AS line_start, left(sha256(string_agg(line, chr(10) ORDER BY line_no)), 16) AS digest FROM g GROUP BY doc_id, sec_no)"


@_register(_MD + _SECTIONS + "SELECT * FROM sec")
def section_hash(spark, sf_dir):
    return layout.sections(_md(spark, sf_dir)).select("doc_id", "sec_no", F.col("line_start").cast("long").alias("line_start"), "digest")


@_register("SELECT doc_id, (2 * length(text) - length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}\\x{ff00}-\\x{ffef}]', '', 'g')))::BIGINT AS width FROM documents")
def visual_width(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", layout.visual_width(F.col("text")).cast("long").alias("width"))


# -- SQL aggregates that both engines read alike -------------------------------------------------

#: Price of 1000 prompt and completion tokens by provider.
PRICES = {"cloudflare": (0.00063, 0.00252), "xiaomi_mimo": (0.00014, 0.00056), "longcat": (0.00014, 0.00056), "siliconflow": (0.00014, 0.00056), "sensenova": (0.001, 0.002), "glm": (0.001, 0.002), "agnes": (0.0005, 0.0015), "dahl": (0.0005, 0.0015), "nvidia": (0.0007, 0.0021), "bailian": (0.0004, 0.0012), "qianfan": (0.0008, 0.0024), "ollama": (0.0, 0.0)}
_NAMES = [*PRICES, "unknown"]
_PRICE_ROWS = ", ".join(f"({i}, '{n}', CAST({PRICES.get(n, (0.001, 0.002))[0]} AS DOUBLE), CAST({PRICES.get(n, (0.001, 0.002))[1]} AS DOUBLE))" for i, n in enumerate(_NAMES))
_CALLS = f"""
WITH prices AS (SELECT * FROM (VALUES {_PRICE_ROWS}) AS t(k, provider, pp, cp)),
calls AS (SELECT conv_id, provider, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS completion, max(pp) AS pp, max(cp) AS cp
  FROM {{conversations}} JOIN prices ON conv_id % 13 = k GROUP BY conv_id, provider),
costs AS (SELECT conv_id, provider, prompt, completion, (prompt * pp + completion * cp) / 1000 AS cost FROM calls)
"""

_SHARED = {
    "cost_by_provider": _CALLS + "SELECT provider, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens, CAST(sum(prompt + completion) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS cost FROM costs GROUP BY provider",
    "cost_summary": _CALLS + "SELECT count(*) AS calls, round(sum(cost), 4) AS total, round(10 - sum(cost), 4) AS remaining, sum(cost) > 10 AS exceeded FROM costs",
    "quality_totals": "SELECT count(*) AS n, count(DISTINCT source) AS tasks, round(avg(CAST(n_chars % 101 AS DOUBLE)), 4) AS avg_score FROM {documents}",
    "log_filter": "SELECT event_id, user_id, event_type FROM {events} WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-10 00:00:00'",
    "backup_tiered": "SELECT file, doc_id FROM (SELECT source AS file, doc_id, doc_id % 120 AS age, row_number() OVER (PARTITION BY source, CASE WHEN doc_id % 120 <= 30 THEN doc_id ELSE -1 END ORDER BY doc_id % 120, doc_id DESC) AS n FROM {documents} WHERE doc_id % 120 <= 90) AS r WHERE age <= 30 OR n = 1",
    "query_dedup": "SELECT conv_id, turn, query FROM (SELECT conv_id, turn, trim(text) AS query, row_number() OVER (PARTITION BY trim(text) ORDER BY conv_id, turn) AS n FROM {conversations} WHERE role = 'user' AND trim(text) <> '') AS r WHERE n = 1",
    "chunk_dedup": "SELECT page_id, title FROM (SELECT page_id, title, row_number() OVER (PARTITION BY substring(lower(trim(title)), 1, 50) ORDER BY page_id) AS n FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM {pages}) AS t WHERE trim(title) <> '') AS r WHERE n = 1",
    "polish_gate": _MD.replace("FROM documents", "FROM {documents}") + "SELECT doc_id, length(text) >= 500 AND text LIKE '%](http%' AND length(concat(chr(10), text)) - length(replace(concat(chr(10), text), concat(chr(10), '## '), '')) >= 12 AS skip FROM md",
    "lint_p0": _MD.replace("FROM documents", "FROM {documents}") + "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'content' ELSE 'size' END AS issue FROM md WHERE trim(text) = '' OR bit_length(text) > 8 * 10 * 1024 * 1024",
    "lint_missing_sections": _MD.replace("FROM documents", "FROM {documents}") + "SELECT doc_id, NOT (text LIKE '%常见问题%' OR lower(text) LIKE '%faq%') AS faq, NOT (text LIKE '%最佳实践%' OR lower(text) LIKE '%best_practice%') AS practice, NOT (text LIKE '%故障排查%' OR lower(text) LIKE '%troubleshoot%') AS trouble FROM md",
}


def shared_sql(name: str) -> str:
    """The oracle SQL of one of the queries whose text names its tables in braces."""
    return _SHARED[name].format(**{t: t for t in ("events", "documents", "conversations", "pages")})


# -- sequential control ------------------------------------------------------------------------


@_register("WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) SELECT word, n FROM (SELECT word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ('the', 'are', 'was', 'were', 'been') GROUP BY word) ORDER BY n DESC, word LIMIT 10")
def keyword_top10(spark, sf_dir):
    """The ten most frequent words (a top-k report)."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter((F.length("word") > 2) & ~F.col("word").isin("the", "are", "was", "were", "been"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(10)



_STOP = ", ".join(f"'{w}'" for w in writer.STOP_WORDS)


@_register(rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x85\p{{Z}}]', ' ', 'g')), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+')) AS word FROM documents),
n AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY ALL)
SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM n) WHERE k <= 10""")
def document_keywords(spark, sf_dir):
    """The ten most frequent words of each text, without punctuation and split at all white space; equal counts in the words' order."""
    return writer.keywords(load(spark, sf_dir, "documents"), "doc_id", "text")


# -- further document operators ------------------------------------------------------------------

_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]{{{{2,}}}}')".replace("{{{{2,}}}}", "{{2,}}")
_HOLLOW = ", ".join(f"'{w}'" for w in quality.HOLLOW_WORDS)
_SUBSTANCE = rf"""
, su AS (SELECT doc_id, text, ps, CASE WHEN len(ws) > 0 AND density < 0.4 THEN 25 * (0.4::DOUBLE - density) / 0.4::DOUBLE ELSE 0::DOUBLE END AS thin, CASE WHEN most > 0.6 THEN 30 * (most - 0.6::DOUBLE) / 0.4::DOUBLE ELSE 0::DOUBLE END AS alike
 FROM (SELECT *, len(list_filter(ws, lambda w: lower(w) NOT IN ({_HOLLOW}))) / greatest(len(ws), 1) AS density,
   coalesce(list_max(list_transform(range(2, len(ps) + 1), lambda i: CASE WHEN len(ps[i]) > 0 AND len(ps[i - 1]) > 0 THEN len(list_intersect(ps[i], ps[i - 1])) / len(list_distinct(list_concat(ps[i], ps[i - 1]))) ELSE 0 END)), 0) AS most
  FROM (SELECT doc_id, text, {_TOKENS.format("text")} AS ws, list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(trim(p)) > 30), lambda p: list_distinct({_TOKENS.format("p")})) AS ps FROM md))),
sub AS (SELECT doc_id, CASE WHEN len(ps) = 0 THEN 0::DOUBLE ELSE greatest(0, 100 - thin - alike - CASE WHEN regexp_matches(text, '\p{{Nd}}') OR contains(text, '```') OR regexp_matches(text, '(?m)^\s*[-*]\s') THEN 0 ELSE 20 END)::DOUBLE END AS substance FROM su)
"""
_EVERY = quality.topic_tokens([TOPIC])[0]
_COVER = lambda x: "(" + " + ".join(f"contains({x}, '{t}')::INT" for t in _EVERY) + f") / {len(_EVERY)}::DOUBLE"
_TOPIC = f", tr AS (SELECT doc_id, round(least(100, {_COVER('lower(text)')} * 70 + {_COVER('array_to_string(list_slice(string_split(lower(text), chr(10)), 1, 30), chr(10))')} * 30), 1)::DOUBLE AS topic_relevance FROM md)"


@_register(_MD + _SUBSTANCE + "SELECT doc_id, round(substance, 6) AS score FROM sub")
def score_substance(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.round(quality.substance(F.col("text")), 6).alias("score"))


@_register(_MD + _TOPIC + "SELECT doc_id, topic_relevance AS score FROM tr")
def score_topic_relevance(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", quality.topic_relevance(F.col("text"), [TOPIC]).alias("score"))


_STYLE = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {c} ELSE 0 END" for _, p, c in quality.STYLE_RULES)
_PAIRS = r"regexp_extract_all(text, '\[[^\]]*\]\([^)]+\)')"
_ISSUES = rf"(len(list_filter({_PAIRS}, lambda x: NOT regexp_matches(regexp_extract(x, '\]\(([^)]*)\)', 1), '^(https?://|#|/)'))) + len(list_filter({_PAIRS}, lambda x: trim(regexp_extract(x, '\[([^\]]*)\]', 1)) = '')))"


@_register(_MD + f"SELECT doc_id, ({_STYLE})::BIGINT AS penalty FROM md")
def style_issues(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", quality.style_penalty(F.col("text")).cast("long").alias("penalty"))


@_register(_MD + f"SELECT doc_id, {_ISSUES}::BIGINT AS issues FROM md")
def citation_report(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", quality.citation_issues(F.col("text")).cast("long").alias("issues"))


@_register(_MD + rf""", u AS (SELECT doc_id, {_ISSUES}::BIGINT AS issues, list_transform(regexp_extract_all(text, '\[[^\]]*\]\([^)]*\)'), lambda x: regexp_extract(x, '\]\(([^)]*)\)', 1)) AS urls FROM md)
SELECT doc_id, len(urls)::BIGINT AS total_refs, len(list_distinct(urls))::BIGINT AS unique_urls, len(list_filter(list_distinct(urls), lambda u: len(list_filter(urls, lambda v: v = u)) > 1))::BIGINT AS duplicates, issues FROM u""")
def citation_counts(spark, sf_dir):
    """The whole citation report: links, different targets, targets that occur more than once, and issues."""
    return _md(spark, sf_dir).select("doc_id", *quality.citation_counts(F.col("text")))


@_register(r"""
WITH a AS (SELECT page_id, unnest(hits) AS hit, unnest(range(len(hits))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a[^>]+href="https?://[^"]+"[^>]*>.*?</a>') AS hits FROM pages)),
b AS (SELECT page_id, pos, regexp_extract(hit, '(?s)<a[^>]+href="(https?://[^"]+)"', 1) AS url, trim(regexp_replace(regexp_extract(hit, '(?s)<a[^>]+href="https?://[^"]+"[^>]*>(.*?)</a>', 1), '<[^>]+>', '', 'g')) AS title FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM b WHERE length(title) >= 5 AND NOT regexp_matches(url, 'google\.com|bing\.com|sogou\.com|so\.com'))
SELECT page_id, pos::BIGINT AS pos, url, title FROM c WHERE n = 1""")
def serp_anchor_extract(spark, sf_dir):
    return serp.anchors(load(spark, sf_dir, "pages"), "page_id", "html").withColumn("pos", F.col("pos").cast("long"))


_HITS = {name: " + ".join(f"contains(body, '{w}')::INT" for w in words) for name, words in writer.SECTIONS.items()}
_CHOICE = " ".join(f"WHEN {hits} = best THEN '{name}'" for name, hits in _HITS.items())


@_register(_ROWS + f"SELECT pos, CASE WHEN best = 0 THEN '{writer.OTHER}' {_CHOICE} END AS section FROM (SELECT *, greatest({', '.join(_HITS.values())}) AS best FROM (SELECT pos, lower(title || ' ' || snippet) AS body FROM rows))")
def chunk_classify(spark, sf_dir):
    return _rows(spark, sf_dir).select("pos", writer.section_of(F.concat_ws(" ", "title", "snippet")).alias("section"))


@_register("SELECT page_id, CASE WHEN title = '' THEN left(sha256(url), 12) ELSE substr(regexp_replace(title, '[^a-zA-Z0-9_\\x{4e00}-\\x{9fff}-]', '_', 'g'), 1, 60) END AS file FROM (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)".replace("\\\\", "\\"))
def article_sink_projection(spark, sf_dir):
    titled = load(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return titled.select("page_id", writer.safe_name(F.col("title"), F.col("url")).alias("file"))


@_register(_MD + _LINES + "SELECT doc_id, line_no::BIGINT AS line_no FROM l WHERE regexp_matches(line, '[│─┌┐└┘├┤┬┴┼〇]')")
def lint_box_chars(spark, sf_dir):
    return layout.lines(_md(spark, sf_dir)).filter(F.col("line").rlike("[│─┌┐└┘├┤┬┴┼〇]")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@_register()
def md_to_html(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", convert.markdown_html("text").alias("html"))


@_register()
def version_diff(spark, sf_dir):
    """Each document's Markdown against its plain text, as a unified diff."""
    texts = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"))
    return _md(spark, sf_dir).join(texts, "doc_id").select("doc_id", convert.unified_diff("old", "text").alias("diff"))


@_register("SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 3 AS healthy FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM events) AS r")
def provider_health(spark, sf_dir):
    calls = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("success"))
    return control.provider_health(calls, "user_id", ["ts", "event_id"], "success").select("event_id", "healthy")


# -- rewritten texts, tables, checks -----------------------------------------------------------

_BARE = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
#: Each document and a rewrite of it: without its fence, with further chapters, or as it was.
_PAIR = _MD + """, pair AS (SELECT doc_id, original, CASE doc_id % 4 WHEN 0 THEN replace(original, chr(10) || '```', '') WHEN 1 THEN replace(original, '#### ', '##### ') WHEN 2 THEN '## New' || chr(10) || original || chr(10) || ' ## Newer ' ELSE original || chr(10) || '优化后的内容' END AS rewritten
  FROM (SELECT doc_id, text || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '#### Deep ' || doc_id AS original FROM md))
"""
_MARKS = ", ".join(f"'{x}'" for x in enhance.META_LINES)
_SPLIT = "string_split({x}, chr(10))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAIR.replace("FROM documents", "FROM {documents}") + "SELECT * FROM pair", documents=load(spark, sf_dir, "documents"))


@_register(r"SELECT conv_id, turn, regexp_replace(regexp_replace('<think>a' || chr(10) || '</think> ' || text, '(?s)<\s*think\s*>.*?<\s*/\s*think\s*>', '', 'g'), '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def think_strip(spark, sf_dir):
    thought = F.concat(F.lit("<think>a\n</think> "), "text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", enhance.without_thoughts(thought).alias("answer"))


@_register(r"SELECT page_id, regexp_replace(url, '([\[\]()*_])', '\\\1', 'g') AS escaped FROM pages")
def markdown_escape(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", enhance.escaped(F.col("url")).alias("escaped"))


@_register(_PAIR + f"SELECT doc_id, sha256(array_to_string(list_filter({_SPLIT.format(x='rewritten')}, lambda x: NOT (regexp_matches({_BARE.format(x='x')}, '^## .*\\S') OR {_BARE.format(x='x')} IN ({_MARKS}))), chr(10))) AS digest FROM pair")
def llm_output_clean(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.sha2(enhance.cleaned(F.col("rewritten")), 256).alias("digest"))


@_register(_PAIR + "SELECT doc_id, sha256(CASE WHEN len(regexp_extract_all(original, '\\n```')) <> len(regexp_extract_all(rewritten, '\\n```')) OR len(list_filter(regexp_extract_all(original, '(?m)^#### .+'), lambda x: NOT list_contains(regexp_extract_all(rewritten, '(?m)^#### .+'), x))) > 0 THEN original ELSE rewritten END) AS digest FROM pair")
def enhance_guard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.sha2(enhance.guarded(F.col("original"), F.col("rewritten")), 256).alias("digest"))


@_register(_PAIR + f""", t AS (SELECT doc_id, rewritten, list_transform({_SPLIT.format(x='original')}, lambda x: {_BARE.format(x='x')}) AS known FROM pair)
SELECT doc_id, sha256(array_to_string(list_transform({_SPLIT.format(x='rewritten')}, lambda x: CASE WHEN regexp_matches({_BARE.format(x='x')}, '^## .*\\S') AND NOT list_contains(known, {_BARE.format(x='x')}) THEN '**' || substr({_BARE.format(x='x')}, 4) || '**' ELSE x END), chr(10))) AS digest FROM t""")
def fake_heading_demote(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.sha2(enhance.demoted(F.col("rewritten"), enhance.chapters(F.col("original"))), 256).alias("digest"))


_TABLES = _MD.replace("WITH md AS (SELECT doc_id, ", "WITH md AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 | 3 |' WHEN 1 THEN '| a | |' || chr(10) || '| - |' || chr(10) || '| 1 |' ELSE '|a|b|' END || chr(10) || ", 1)


@_register(_TABLES + _LINES + r""", a AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare, regexp_matches(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), '\|\s*[-:]+\s*\|') AS near FROM l),
b AS (SELECT *, sum(CASE WHEN starts_with(bare, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM a),
c AS (SELECT *, min(CASE WHEN near THEN line_no END) OVER (PARTITION BY doc_id, run) AS start, len(list_filter(string_split(bare, '|'), lambda x: regexp_matches(x, '\S'))) AS cells FROM b WHERE starts_with(bare, '|') AND NOT regexp_matches(bare, '^\|[\s\-:]+\|$'))
SELECT doc_id, min(line_no)::BIGINT AS line_no, max(cells)::BIGINT AS widest FROM c WHERE line_no >= start GROUP BY doc_id, run HAVING min(cells) < max(cells)""")
def lint_table_columns(spark, sf_dir):
    docs = spark.sql(_TABLES.replace("FROM documents", "FROM {documents}") + "SELECT * FROM md", documents=load(spark, sf_dir, "documents"))
    return layout.ragged_tables(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("widest").cast("long").alias("widest"))


@_register(_MD + r""", a AS (SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\S') OR strlen(text) > 10485760 THEN 1 ELSE 0 END AS p0, len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1b\x1f]')) + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[│─┌┐└┘├┤┬┴┼〇]'))) + CASE WHEN len(regexp_extract_all(text, '(?m)^#{1,2}\s+\S')) < 3 THEN 1 ELSE 0 END AS p1 FROM md)
SELECT doc_id, p0::BIGINT AS p0, (CASE WHEN p0 > 0 THEN 0 ELSE p1 END)::BIGINT AS p1, CASE WHEN p0 > 0 THEN 'blocked' WHEN p1 > 0 THEN 'fail' ELSE 'pass' END AS status FROM a""")
def checker_verdict(spark, sf_dir):
    p0, p1 = layout.check_counts(F.col("text"))
    return _md(spark, sf_dir).select("doc_id", p0.alias("p0"), p1.alias("p1")).withColumn("status", layout.check_status(F.col("p0"), F.col("p1")))


# -- several engines and sites -----------------------------------------------------------------


@_register("WITH r AS (SELECT page_id % 20 AS query, page_id % 3 AS rank, page_id, split_part(url, '?', 1) AS url FROM pages), a AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY rank, page_id) AS n FROM r WHERE url <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, page_id) AS m FROM a WHERE n = 1) SELECT query, page_id, url FROM b WHERE m <= 10")
def engine_fallback(spark, sf_dir):
    """Rows of three engines (by id) for twenty queries, ten a query."""
    rows = load(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("query"), (F.col("page_id") % 3).alias("rank"), "page_id", F.substring_index("url", "?", 1).alias("url"))
    return search.merged(rows, "query", ["rank", "page_id"], 10).select("query", "page_id", "url")


_SITES = ", ".join(f"('{d}', '{n}')" for d, n in search.SITES)


@_register(f"SELECT conv_id, turn, site, 'site:' || domain || ' ' || text AS site_query FROM conversations, (VALUES {_SITES}) s(domain, site) WHERE role = 'user'")
def site_search(spark, sf_dir):
    return search.site_queries(load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "site", "site_query")


@_register("""WITH r AS (SELECT page_id % 20 AS query, page_id, url, 'web' AS source, page_id % 5 AS part FROM pages),
s AS (SELECT *, row_number() OVER (PARTITION BY query, part ORDER BY page_id) AS k FROM r WHERE part > 2),
u AS (SELECT query, page_id, url, source, false AS late FROM r WHERE part <= 2 UNION ALL SELECT query, page_id, url, source || '[' || part || ']', true FROM s WHERE k <= 3),
a AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY late, page_id) AS n FROM u WHERE url <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY late, page_id) AS m FROM a WHERE n = 1)
SELECT query, page_id, source FROM b WHERE m <= 20""")
def site_union(spark, sf_dir):
    """Web rows, then at most three of each site (two parts of the pages)."""
    rows = load(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("query"), "page_id", "url", F.lit("web").alias("source"), (F.col("page_id") % 5).alias("part"))
    sites = rows.filter("part > 2").withColumn("site", F.col("part").cast("string")).drop("part")
    return search.with_sites(rows.filter("part <= 2").drop("part"), sites, "query", ["page_id"], 20).select("query", "page_id", "source")


_TOPIC_WORDS = TOPIC.split()
_POINTS = lambda words: "(" + " + ".join(f"{2 if w in _TOPIC_WORDS else 1} * contains(low, '{w}')::INT" for w in (*words, *_TOPIC_WORDS)) + ")"


@_register(r"""WITH p AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)), q AS (SELECT *, lower(text) AS low FROM p WHERE length(text) > 50),
s AS (""" + " UNION ALL ".join(f"SELECT {k} AS section, doc_id, i, text, {_POINTS(words)} / greatest(length(text) / 1000::DOUBLE, 1) AS score FROM q" for k, (_, words) in enumerate(writer.PLAN)) + """),
a AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id, i) AS n FROM s WHERE score > 0), b AS (SELECT *, row_number() OVER (PARTITION BY section, left(text, 200) ORDER BY n) AS m FROM a WHERE n <= 3)
SELECT section, doc_id, i::BIGINT AS i, round(score, 6) AS score FROM b WHERE m = 1""")
def section_top3(spark, sf_dir):
    """The three best paragraphs of each section of the fixed plan."""
    paragraphs = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("i"), enhance.stripped(F.col("line")).alias("text")).filter("length(text) > 50")
    return writer.section_paragraphs(paragraphs, ["doc_id", "i"], _TOPIC_WORDS).select("section", "doc_id", "i", F.round("score", 6).alias("score"))


# Further modules register their queries when they are imported.
from scriptorium import catalog_build, catalog_ops, catalog_search, catalog_text, catalog_time  # noqa: E402, F401
