"""Queries of the operators that build documents: skeletons, fill, whole documents, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import _CHOICE, _HITS, _ROWS, _rows
from scriptorium.catalog_search import _BLANK, _STRIP
from scriptorium.operators import build, writer
from scriptorium.registry import register
from scriptorium.tables import load

_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_QUERY = "CASE task % 4 WHEN 0 THEN '' WHEN 1 THEN 'there edtion 的' WHEN 2 THEN 'a' ELSE 'Kafka 在 生产' END"

#: Articles of fifty tasks: the documents, their lines as paragraphs.
_ARTICLES = f"""
WITH art AS (SELECT doc_id % 50 AS task, doc_id AS place, source AS title, 'https://e.org/' || (doc_id % 7) AS url, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS text FROM documents),
tasks AS (SELECT task, 'T' || task AS title, {_QUERY} AS query FROM (SELECT DISTINCT task FROM art))
"""


def _articles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf_dir, "documents")
    art = docs.selectExpr("doc_id % 50 AS task", "doc_id AS place", "source AS title", "concat('https://e.org/', doc_id % 7) AS url", "replace(text, '\n', '\n \n') AS text")
    return art.select("task").distinct().selectExpr("task", "concat('T', task) AS title", f"{_QUERY} AS query"), art


_SKELETON = rf"""
, w AS (SELECT task, query, regexp_extract_all(query, '{_WORD}+') AS words FROM tasks),
ln AS (SELECT task, place, list_filter(list_transform(string_split(text, chr(10)), lambda p: {_STRIP('p')}), lambda p: length(p) > 40)[1:30] AS ls FROM art),
le AS (SELECT task, place, unnest(ls) AS line, unnest(range(len(ls))) AS ix FROM ln),
mt AS (SELECT le.*, regexp_extract_all(line, '{_WORD}{{2,}}')[1:5] AS five FROM le JOIN w USING (task) WHERE len(list_filter(words, lambda x: contains(lower(line), lower(x)))) > 0),
fw AS (SELECT task, place, ix, unnest(five) AS word, unnest(range(len(five))) AS i FROM mt),
f1 AS (SELECT task, word, min({{'a': place, 'b': ix, 'c': i}}) AS first FROM fw GROUP BY task, word), f2 AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY first) AS n FROM f1),
ex AS (SELECT task, list(word ORDER BY n) AS extracted FROM f2 WHERE n <= 8 GROUP BY task),
co AS (SELECT w.*, extracted, list_filter(words, lambda x: length(x) > 1 AND x NOT IN ({_IN(build.NOT_CORE)})) AS core FROM w LEFT JOIN ex USING (task)),
pl AS (SELECT task, CASE WHEN query = '' THEN [{', '.join(f"{{'heading': '{h}', 'keywords': []::VARCHAR[]}}" for h in build.PLAIN_SKELETON)}] ELSE list_filter([
  {{'heading': '简介', 'keywords': list_concat(words[1:3], {_LIST(build.INTRO_WORDS)})}}, CASE WHEN len(core) > 0 THEN {{'heading': '核心概念', 'keywords': list_concat(core, {_LIST(build.CORE_WORDS)})}} END,
  CASE WHEN extracted IS NOT NULL THEN {{'heading': '详细分析', 'keywords': extracted}} END, {{'heading': '实践与应用', 'keywords': {_LIST(build.PRACTICE_WORDS)}}}, {{'heading': '总结', 'keywords': {_LIST(build.END_WORDS)}}}], lambda x: x IS NOT NULL) END AS plan FROM co),
sec AS (SELECT task, unnest(plan).heading AS heading, unnest(plan).keywords AS keywords, unnest(range(len(plan))) AS section FROM pl)
"""
_PARAGRAPHS = rf"""
, pc AS (SELECT task, place, title, url, unnest(regexp_split_to_array(text, '\n{_BLANK}*\n')) AS raw, unnest(range(len(regexp_split_to_array(text, '\n{_BLANK}*\n')))) AS ix FROM art),
pt AS (SELECT * EXCLUDE (raw), {_STRIP('raw')} AS bare FROM pc), pv AS (SELECT * EXCLUDE (bare), CASE WHEN length(bare) > 3000 THEN left(bare, 3000) || '...' ELSE bare END AS text FROM pt WHERE length(bare) >= 40 AND NOT regexp_matches(bare, '{build.BOILERPLATE}')),
pd AS (SELECT *, row_number() OVER (PARTITION BY task, left(text, 200) ORDER BY place, ix) AS n FROM pv), para AS (SELECT task, place, ix, title, url, text FROM pd WHERE n = 1)
"""
_FILL = rf"""
, te AS (SELECT task, place, ix, unnest(regexp_extract_all(lower(text), '{_WORD}{{2,}}')) AS term FROM para), tn AS (SELECT task, place, ix, term, count(*) AS n FROM te GROUP BY ALL),
tf AS (SELECT *, n / max(n) OVER (PARTITION BY task, place, ix) AS tf FROM tn), tot AS (SELECT task, count(*) AS total FROM para GROUP BY task),
ids AS (SELECT task, term, ln((any_value(total) + 1) / (count(*) + 1)) + 1 AS idf FROM tn JOIN tot USING (task) GROUP BY task, term), we AS (SELECT task, place, ix, term, tf * idf AS w FROM tf JOIN ids USING (task, term)),
nm AS (SELECT task, place, ix, sqrt(sum(w * w)) AS norm FROM we GROUP BY ALL),
ks AS (SELECT task, section, keywords, list_distinct(list_filter(list_transform(keywords, lambda k: lower(k)), lambda k: length(k) > 1)) AS keys FROM sec), kx AS (SELECT task, section, len(keys) AS n_keys, unnest(keys) AS term FROM ks),
ht AS (SELECT task, section, place, ix, sum(w) / (any_value(norm) * sqrt(any_value(n_keys))) AS score FROM kx JOIN we USING (task, term) JOIN nm USING (task, place, ix) GROUP BY task, section, place, ix),
ch AS (SELECT task, section, place, ix, row_number() OVER (PARTITION BY task, section ORDER BY round(score, 9) DESC, place, ix) AS rank FROM ht WHERE score > 0.01),
ba AS (SELECT task, section, CASE WHEN len(keywords) = 0 THEN 8 ELSE 3 END AS most FROM ks WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.task = ks.task AND ch.section = ks.section AND ch.rank <= 8)),
fi AS (SELECT task, place, ix, row_number() OVER (PARTITION BY task ORDER BY place, ix) AS rank FROM para),
al AS (SELECT task, section, place, ix, rank FROM ch WHERE rank <= 8 UNION ALL SELECT ba.task, section, place, ix, rank FROM ba JOIN fi ON ba.task = fi.task AND rank <= most),
ow AS (SELECT *, row_number() OVER (PARTITION BY task, place, ix ORDER BY section) AS own FROM al), filled AS (SELECT task, section, rank, title, url, text FROM ow JOIN para USING (task, place, ix) WHERE own = 1)
"""
_DOCUMENT = rf"""
, bo AS (SELECT task, section, list({{'text': text, 'title': title, 'url': url}} ORDER BY rank) AS rows FROM filled GROUP BY ALL),
pa AS (SELECT task, section, heading, '## ' || heading || chr(10) || chr(10) || CASE WHEN rows IS NULL THEN '{build.EMPTY_SECTION}' || chr(10) ELSE array_to_string(list_transform(rows, lambda r: r.text), chr(10) || chr(10)) || chr(10) END || chr(10) || '---' || chr(10) AS text,
  coalesce(rows, []) AS rows FROM sec LEFT JOIN bo USING (task, section)),
wh AS (SELECT task, list(heading ORDER BY section) AS headings, string_agg(text, chr(10) ORDER BY section) AS body FROM pa GROUP BY task),
rf AS (SELECT task, section, unnest(rows) AS r, unnest(range(len(rows))) AS i FROM pa), r1 AS (SELECT task, r.url AS url, r.title AS title, section, i, row_number() OVER (PARTITION BY task, r.url ORDER BY section, i) AS n FROM rf),
rl AS (SELECT task, string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY section, i) AS refs FROM r1 WHERE n = 1 AND url <> '' GROUP BY task)
SELECT task, sha256('# ' || title || chr(10) || chr(10) || CASE WHEN query <> '' THEN '> 主题: ' || query || chr(10) ELSE '' END || chr(10) || '## 目录' || chr(10) || chr(10) || array_to_string(list_transform(headings, lambda h: '1. [' || h || '](#' || h || ')'), chr(10))
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body || CASE WHEN refs IS NULL THEN '' ELSE chr(10) || '## 参考资料' || chr(10) || chr(10) || refs || chr(10) END) AS digest FROM tasks JOIN wh USING (task) LEFT JOIN rl USING (task)
"""


@register(_ARTICLES + _SKELETON + "SELECT task, section, heading, array_to_string(keywords, ' ') AS keywords FROM sec")
def document_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build.skeleton(*_articles(spark, sf_dir))
    return found.select("task", F.col("section").cast("long").alias("section"), "heading", F.array_join("keywords", " ").alias("keywords"))


@register(_ARTICLES + _PARAGRAPHS + "SELECT task, place, ix, sha256(text) AS digest FROM para")
def useful_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.paragraphs_of(_articles(spark, sf_dir)[1]).select("task", "place", F.col("at").cast("long").alias("ix"), F.sha2("text", 256).alias("digest"))


@register(_ARTICLES + _SKELETON + _PARAGRAPHS + _FILL + "SELECT task, section, rank, url, sha256(text) AS digest FROM filled")
def skeleton_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, art = _articles(spark, sf_dir)
    found = build.fill(build.skeleton(tasks, art), build.paragraphs_of(art))
    return found.select("task", F.col("section").cast("long").alias("section"), F.col("rank").cast("long").alias("rank"), "url", F.sha2("text", 256).alias("digest"))


@register(_ARTICLES + _SKELETON + _PARAGRAPHS + _FILL + _DOCUMENT)
def article_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each task's whole document."""
    return build.article_document(*_articles(spark, sf_dir)).select("task", F.sha2("content", 256).alias("digest"))


_ESC = lambda x: rf"regexp_replace({x}, '([\[\]()*_])', '\\\1', 'g')"
_PLACES = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(build.SECTION_ORDER))


@register(_ROWS + rf""", k AS (SELECT *, pos % 30 AS task, left(lower({_STRIP('title')}), 50) AS k FROM rows), d AS (SELECT *, row_number() OVER (PARTITION BY task, k ORDER BY pos) AS n, lower(title || ' ' || snippet) AS body FROM k WHERE k <> ''),
c AS (SELECT *, CASE WHEN best = 0 THEN '{writer.OTHER}' {_CHOICE} END AS section FROM (SELECT *, greatest({', '.join(_HITS.values())}) AS best FROM d WHERE n = 1)),
s AS (SELECT task, section, CASE section {_PLACES} END AS place, '## ' || section || chr(10) || chr(10) || string_agg('### ' || title || chr(10) || chr(10) || snippet, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) AS text, string_agg('- [' || {_ESC('title')} || '](' || {_ESC('url')} || ')', chr(10) ORDER BY pos) AS refs FROM c GROUP BY task, section)
SELECT task, sha256(string_agg(text, chr(10) ORDER BY place) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 参考资料' || chr(10) || chr(10) || string_agg(refs, chr(10) ORDER BY place) || chr(10)) AS digest FROM s GROUP BY task""")
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a document of search rows for each of thirty tasks."""
    rows = _rows(spark, sf_dir).select((F.col("pos") % 30).alias("task"), "pos", "title", F.col("snippet").alias("content"), "url")
    return build.chunk_document(rows, "pos").select("task", F.sha2("body", 256).alias("digest"))


_FITS = lambda name, x: f"(contains({x}, '{name}') OR contains('{name}', {x}))"
_HEADINGS = ("简介", "核心概念与原理", "详细分析", "实践与应用", "总结", "别的")


@register("WITH h AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(_HEADINGS)) + ") t(i, h)), d AS (SELECT doc_id, a.h AS before, b.h AS after FROM documents JOIN h a ON doc_id % 6 = a.i JOIN h b ON doc_id // 6 % 6 = b.i) SELECT doc_id, CASE " + " ".join(f"WHEN {_FITS(a, 'before')} AND {_FITS(b, 'after')} THEN '{t}'" for a, b, t in build.TRANSITIONS) + " END AS sentence FROM d")
def transition_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*map(F.lit, _HEADINGS))
    pick = lambda x: F.element_at(heads, (x % 6 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", build.transition(pick(F.col("doc_id")), pick(F.floor(F.col("doc_id") / 6))).alias("sentence"))


@register(rf"""WITH d AS (SELECT doc_id, source AS title, CASE doc_id % 3 WHEN 0 THEN '# ' || source || chr(10) || text || chr(10) || '## 参考资料' || chr(10) || ' ' WHEN 1 THEN 'x' || chr(10) || '## 参考资料' || chr(10) || chr(10) || '## Next' || chr(10) || text ELSE text END AS text FROM documents),
e AS (SELECT doc_id, title, {_STRIP(rf"regexp_replace(regexp_replace(text, '\n## 参考资料\n{_BLANK}*\z', ''), '\n## 参考资料{_BLANK}*\n(## )', {chr(39)}{chr(10)}\1{chr(39)}, 'g')")} AS text FROM d)
SELECT doc_id, CASE WHEN starts_with(text, '# ' || title) THEN text ELSE '# ' || title || chr(10) || chr(10) || text END AS text FROM e""")
def tidy_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = "CASE doc_id % 3 WHEN 0 THEN concat('# ', source, '\n', text, '\n## 参考资料\n ') WHEN 1 THEN concat('x\n## 参考资料\n\n## Next\n', text) ELSE text END AS text"
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "source AS title", ends)
    return docs.select("doc_id", build.tidy_references(F.col("text"), F.col("title")).alias("text"))


_DROP5 = "html"
for _name in ("script", "style", "nav", "header", "footer"):
    _DROP5 = f"regexp_replace({_DROP5}, '(?is)<{_name}[^>]*>.*?</{_name}>', '', 'g')"
_SIMPLE = f"regexp_replace({_DROP5}, '<[^>]+>', ' ', 'g')"
for _ref, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
    _SIMPLE = f"replace({_SIMPLE}, '{_ref}', '{_char}')"
_SIMPLE = _STRIP(f"regexp_replace({_SIMPLE}, '{_BLANK}+', ' ', 'g')")


@register(f"SELECT page_id, left(t, 10000) AS text FROM (SELECT page_id, {_SIMPLE} AS t FROM pages) WHERE length(t) > 200")
def page_simple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple text of pages that are long enough, cut to 10,000 characters as the rule says."""
    texts = load(spark, sf_dir, "pages").select("page_id", F.explode(F.array(build.simple_text(F.col("html")))).alias("text"))
    return build.usable_articles(texts)


_TOPIC = ["apache", "kafka", "there", "edtion"]
_PLANNED = writer.PLAN
_POINT = lambda words: "(" + " + ".join(f"{2 if w in _TOPIC else 1} * contains(low, '{w}')::INT" for w in (*words, *_TOPIC)) + ")"


@register(rf"""WITH l AS (SELECT doc_id, unnest(string_split(left(text, 10000), chr(10))) AS line, unnest(range(len(string_split(left(text, 10000), chr(10))))) AS i FROM documents WHERE length(text) > 200), p AS (SELECT doc_id, i, {_STRIP('line')} AS text FROM l), q AS (SELECT *, lower(text) AS low FROM p WHERE length(text) > 50),
s AS (""" + " UNION ALL ".join(f"SELECT {k} AS section, doc_id, i, text, {_POINT(words)} / greatest(length(text) / 1000::DOUBLE, 1) AS score FROM q" for k, (_, words) in enumerate(_PLANNED)) + rf"""),
a AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id, i) AS n FROM s WHERE score > 0), b AS (SELECT *, row_number() OVER (PARTITION BY section, left(text, 200) ORDER BY n) AS m FROM a WHERE n <= 3),
h AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{name}')" for i, (name, _) in enumerate(_PLANNED))}) t(section, heading)), g AS (SELECT section, string_agg(text, chr(10) || chr(10) ORDER BY n) AS body FROM b WHERE m = 1 GROUP BY section)
SELECT sha256('# T' || chr(10) || chr(10) || string_agg('## ' || heading || chr(10) || chr(10) || coalesce(body, '{build.EMPTY_SECTION}') || chr(10), chr(10) ORDER BY h.section)) AS digest FROM h LEFT JOIN g USING (section)""")
def three_pass_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of one document from all usable articles."""
    articles = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("order"), "text")
    return build.three_pass_document(articles, _TOPIC, "T").select(F.sha2("content", 256).alias("digest"))
