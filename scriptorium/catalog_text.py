"""Queries of the lint, drawing, value and plan operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import _ISSUES, _LINES, _MD, _SCORES, _STYLE, _SUBSTANCE, _TOPIC, TOPIC, _md
from scriptorium.functions import values
from scriptorium.operators import ascii_art, enhance, layout, lint, quality
from scriptorium.operators import sections as section_ops
from scriptorium.registry import oracle_sql, register
from scriptorium.tables import load

_FULL = _MD + _SCORES + _SUBSTANCE + _TOPIC


@register(_FULL + f"""SELECT doc_id, completeness::DOUBLE AS completeness, structure::DOUBLE AS structure, readability::DOUBLE AS readability, citation::DOUBLE AS citation, depth::DOUBLE AS depth, round(substance, 6) AS substance, topic_relevance, penalty, overall, overall < 70 AS needs_regenerate, overall < 70 AND doc_id % 5 < 3 AS can_regenerate
FROM (SELECT *, round(greatest(0, (0.18::DOUBLE * completeness + 0.12::DOUBLE * structure + 0.10::DOUBLE * readability + 0.12::DOUBLE * citation + 0.10::DOUBLE * depth + 0.18::DOUBLE * substance + 0.20::DOUBLE * topic_relevance) / 1.1::DOUBLE - penalty), 1) AS overall
 FROM (SELECT *, least(({_STYLE}) + 5 * {_ISSUES}, 40)::DOUBLE AS penalty FROM md JOIN s USING (doc_id) JOIN sub USING (doc_id) JOIN tr USING (doc_id)))""")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions, the penalty, the score against 70 and both flags."""
    own = quality.Profile().verdict(_md(spark, sf_dir).select("doc_id", "text"), "text", [TOPIC], F.col("doc_id") % 5)
    return own.drop("text").withColumn("substance", F.round("substance", 6))


#: The tutorial profile: other weights and limits, two of three rules, no citations.
TUTORIAL = {
    "weights": {"completeness": 0.30, "structure": 0.20, "readability": 0.25, "citation": 0.10, "depth": 0.10, "style": 0.05},
    "threshold": 75, "max_penalty": 30, "check_citations": False,
    "style_rules": [{"name": "empty_link", "pattern": r"\[([^\]]*)\]\(\s*\)", "penalty": 15}, {"name": "blank_lines", "pattern": r"\n{4,}", "penalty": 3}, {"name": "deep", "pattern": "^#{4,}", "penalty": 5, "enabled": False}],
}


@register(_MD + _SCORES + r"""SELECT doc_id, penalty, overall, overall < 75 AS needs_regenerate FROM (SELECT *, round(greatest(0, (0.30::DOUBLE * completeness + 0.20::DOUBLE * structure + 0.25::DOUBLE * readability + 0.10::DOUBLE * citation + 0.10::DOUBLE * depth) / 1.0::DOUBLE - penalty), 1) AS overall
 FROM (SELECT *, least(CASE WHEN regexp_matches(text, '\[([^\]]*)\]\(\s*\)') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(text, '\n{4,}') THEN 3 ELSE 0 END, 30)::DOUBLE AS penalty FROM md JOIN s USING (doc_id)))""")
def gate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate by another profile."""
    profile = quality.Profile.of(TUTORIAL)
    return profile.verdict(_md(spark, sf_dir).select("doc_id", "text"), "text", [], F.lit(0)).select("doc_id", "penalty", "overall", "needs_regenerate")


# -- lint --------------------------------------------------------------------------------------

_CONTROLLED = "text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'bell' || chr(7) || ' and ' || chr(27) ELSE '' END"


@register(_MD + f"""SELECT doc_id, line_no AS line, i AS column, code FROM (SELECT doc_id, line_no, unnest(range(1, length(line) + 1)) AS i, ord(unnest(string_split(line, ''))) AS code FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM (SELECT doc_id, {_CONTROLLED} AS t FROM md))) WHERE code BETWEEN 0 AND 31 AND code NOT IN (9, 13)""".replace("AS column", 'AS "column"'))
def lint_control_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.check(_md(spark, sf_dir).withColumn("text", F.expr(_CONTROLLED.replace("chr(", "char(")))).filter("category = 'control_char'")
    return found.select("doc_id", "line", "column", F.conv(F.substring("detail", 3, 2), 16, 10).cast("long").alias("code"))


@register(f"""SELECT doc_id, p0 AS "P0", p1 AS "P1", CASE WHEN p0 > 0 THEN 0 ELSE coalesce(b.n, 0) END AS "P2", CASE WHEN p0 > 0 THEN 0 ELSE coalesce(g.n, 0) + coalesce(t.n, 0) + faq::INT + practice::INT + trouble::INT END AS "P3", CASE WHEN p0 > 0 THEN 'error' WHEN p1 > 0 THEN 'warning' ELSE 'ok' END AS status
FROM ({oracle_sql()['checker_verdict']}) v JOIN ({oracle_sql()['lint_missing_sections']}) m USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({oracle_sql()['lint_blank_runs']}) GROUP BY doc_id) b USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({oracle_sql()['lint_heading_gap']}) GROUP BY doc_id) g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({oracle_sql()['lint_table_columns'].replace("CASE doc_id % 3 WHEN 0 THEN '| a | b |'", "CASE -1 WHEN 0 THEN ''").replace("ELSE '|a|b|' END || chr(10) ||", "ELSE '' END ||")}) GROUP BY doc_id) t USING (doc_id)""")
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document by level, and its status."""
    docs = _md(spark, sf_dir)
    return lint.summary(docs, lint.check(docs))


_OLD = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '## Part', '## Parts') ELSE text || chr(10) || 'more' END"
_TITLED = _MD + _LINES + r""", g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_no FROM l),
sec AS (SELECT doc_id, sec_no, CASE WHEN sec_no > 0 THEN trim(regexp_replace(arg_min(line, line_no), '^#+', '')) ELSE '' END AS title, left(sha256(string_agg(line, chr(10) ORDER BY line_no)), 16) AS digest FROM g GROUP BY doc_id, sec_no),
fin AS (SELECT doc_id, title, arg_max(digest, sec_no) AS digest FROM sec GROUP BY doc_id, title)"""
_CHANGES = f"""SELECT n.doc_id, n.title, CASE WHEN o.digest IS NULL THEN 'new' WHEN o.digest <> n.digest THEN 'modified' ELSE 'unchanged' END AS change
FROM ({_TITLED} SELECT * FROM fin) n LEFT JOIN ({_TITLED.replace(', l AS (SELECT', f', m2 AS (SELECT doc_id, {_OLD} AS text FROM md), l AS (SELECT', 1).replace('AS line_no FROM md)', 'AS line_no FROM m2)')} SELECT * FROM fin) o USING (doc_id, title)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _md(spark, sf_dir)
    return layout.section_changes(layout.sections(docs), layout.sections(docs.withColumn("text", F.expr(_OLD.replace("chr(", "char(")))))


@register(_CHANGES)
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each document against a former state of it."""
    return _changes(spark, sf_dir)


@register(f"SELECT doc_id, {', '.join(f'count(*) FILTER (change = {c!r}) AS {c}' for c in ('new', 'modified', 'unchanged'))} FROM ({_CHANGES}) GROUP BY doc_id")
def incremental_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.change_summary(_changes(spark, sf_dir))


@register()
def lint_yaml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML fences put into each document: sound, broken, commented, JSON and requests by turns."""
    bodies = ("a: 1\nb: [x, y]", "a: [1", "a: b: c # note", "{\"a\": [}", "GET /x\n a: [")
    fence = F.concat(F.lit("\n```yaml\n"), F.element_at(F.array(*map(F.lit, bodies)), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("\n```\n"))
    found = lint.check(_md(spark, sf_dir).withColumn("text", F.concat("text", fence)))
    return found.filter("category LIKE 'yaml%'").select("doc_id", "level", "category", "line")


# -- sections for a rewrite --------------------------------------------------------------------


@register(_MD + r""", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM md), g AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l)
SELECT doc_id, part::BIGINT AS part, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest, length(string_agg(line, chr(10) ORDER BY i) FILTER (part = 0 OR NOT starts_with(line, '## ')))::BIGINT AS n_body FROM g GROUP BY doc_id, part""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = section_ops.split(_md(spark, sf_dir))
    whole = F.when(F.col("title").isNotNull(), F.concat_ws("\n", "title", "body")).otherwise(F.col("body"))
    return own.select("doc_id", F.col("part").cast("long").alias("part"), F.sha2(whole, 256).alias("digest"), F.length("body").cast("long").alias("n_body"))


@register()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies over 300 characters cut at third-level headings, and long pieces of them at line ends."""
    return section_ops.chunks(section_ops.split(_md(spark, sf_dir)), 300).select("doc_id", F.col("part").cast("long").alias("part"), F.col("chunk").cast("long").alias("chunk"), F.length("text").cast("long").alias("n"))


@register(_MD + "SELECT doc_id, sha256(text) AS digest FROM md")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, chunked, put together again: each document as it was."""
    own = section_ops.split(_md(spark, sf_dir))
    return section_ops.joined(own, section_ops.chunks(own, 300)).select("doc_id", F.sha2("text", 256).alias("digest"))


@register()
def enhanced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite of each section in capitals, with a fake chapter and, in every third document, a lost fence; the guards hold it against the original."""
    docs = _md(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n## Last\n```\ncode of it\n```\n#### Deep\nand some more words to make it long enough")))

    def shout(text):
        loud = F.concat(F.upper(text), F.lit("\n## Fake\nmore"))
        return F.when(F.col("doc_id") % 3 == 0, F.replace(loud, F.lit("\n```"), F.lit(""))).otherwise(loud)

    return section_ops.enhanced(docs, shout).select("doc_id", "changed", F.sha2("text", 256).alias("digest"))


# -- values ------------------------------------------------------------------------------------

_MIXED = "CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) ELSE text END"


@register(f"SELECT doc_id, sha256(t) AS lf, sha256(replace(t, chr(10), chr(13) || chr(10))) AS crlf, sha256({_MIXED}) AS auto FROM (SELECT doc_id, text, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)")
def newline_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("mixed", F.expr(_MIXED.replace("chr(", "char(")))
    return docs.select("doc_id", *(F.sha2(values.newlines(F.col("mixed"), m), 256).alias(m) for m in ("lf", "crlf", "auto")))


@register(r"SELECT doc_id, (2 * length(t) - length(regexp_replace(t, '[\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}\x{10000}-\x{10ffff}]', '', 'g')))::BIGINT AS width FROM (SELECT doc_id, text || '漢字（全）😀' AS t FROM documents)")
def byte_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", values.byte_width(F.concat("text", F.lit("漢字（全）😀"))).cast("long").alias("width"))


@register("SELECT event_id, CASE WHEN value >= 10 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key in the object inside each event's line; objects of events below ten are cut off before their brace."""
    held = F.when(F.col("value") >= 10, F.col("props")).otherwise(F.expr("left(props, length(props) - 1)"))
    answer = F.concat(F.lit("Here:\n"), "event_type", F.lit(" "), held, F.lit("\nDone"))
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object(values.rescued_json(answer), "$.k").alias("k"))


@register("""SELECT doc_id, left(sha256('{"a":"' || lang || '","b":"' || source || '","c":"' || doc_id || '"}'), 12) AS digest FROM documents""")
def config_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(F.lit("c"), F.col("doc_id").cast("string"), F.lit("a"), F.col("lang"), F.lit("b"), F.col("source"))
    return load(spark, sf_dir, "documents").select("doc_id", values.config_digest(pairs).alias("digest"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN round((n_chars % 101 + 2.0) / 2, 1) ELSE round((0.7::DOUBLE * (n_chars % 101) + 0.3::DOUBLE * CASE WHEN doc_id % 4 = 1 THEN 9 ELSE 2 END) / (0.7::DOUBLE + 0.3::DOUBLE), 1) END AS mean FROM (SELECT doc_id, CASE WHEN lang = '' THEN 0 ELSE n_chars END AS n_chars FROM documents)")
def weight_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores by a profile's weights with a document's own laid on top; no weights in every fourth."""
    n = F.col("doc_id") % 4
    scores = values.overlaid(F.create_map(F.lit("a"), (F.col("n_chars") % 101).cast("double"), F.lit("b"), F.lit(2.0)), F.when(n == 1, F.create_map(F.lit("b"), F.lit(9.0))).otherwise(F.create_map().cast("map<string,double>")))
    weights = values.overlaid(F.create_map(F.lit("a"), F.lit(0.7), F.lit("b"), F.lit(0.3)), F.when(n == 0, F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), F.lit(0.0))).otherwise(F.create_map().cast("map<string,double>")))
    return load(spark, sf_dir, "documents").select("doc_id", values.weighted_mean(scores, weights).alias("mean"))


_FIELDS = {"user": "CAST(user_id AS {text})", "value": "CAST(CAST(value AS DECIMAL(12,2)) AS {text})", "type": "event_type", "large": "CASE WHEN value >= 50 THEN 'On' ELSE ' no ' END", "props": "props"}


@register("SELECT event_id, name, kind, CASE WHEN kind = 'bool' THEN (l = 'on')::VARCHAR WHEN kind = 'int' THEN l ELSE t END AS value FROM (SELECT *, CASE WHEN l IN ('on', 'no') THEN 'bool' WHEN regexp_full_match(l, '[0-9]+') THEN 'int' WHEN regexp_full_match(l, '[0-9]+[.][0-9]+') THEN 'float' ELSE 'str' END AS kind FROM (SELECT *, lower(trim(t)) AS l FROM (" + " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, {e.format(text='VARCHAR')} AS t FROM events" for n, e in _FIELDS.items()) + ")))")
def env_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every event as a setting's text, and what it is read as."""
    fields = F.array(*(F.struct(F.lit(n).alias("name"), F.expr(e.format(text="STRING")).alias("t")) for n, e in _FIELDS.items()))
    own = load(spark, sf_dir, "events").select("event_id", F.inline(fields))
    return own.select("event_id", "name", values.coerced(F.col("t")).alias("c")).select("event_id", "name", "c.*")


@register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A_API_KEY' WHEN 1 THEN 'A_API_KEY,B_TOKEN' ELSE '' END AS names FROM documents")
def missing_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('# c\nNAME=\nA_API_KEY=', CASE WHEN doc_id % 3 < 2 THEN 'your_key' ELSE 'k1' END, '\nB_TOKEN=', CASE WHEN doc_id % 3 = 1 THEN '' ELSE 't' END)")
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(values.unset_secrets(text), ",").alias("names"))


@register("SELECT doc_id, list_sort(list_distinct([lang, source])) = list_sort(list_distinct([source, lang])) AS same, lang || ',' || source AS kinds, 2::BIGINT AS n FROM documents")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types joined and split again, and two lists compared without regard to their order."""
    kinds = values.listed(F.array("lang", "source"))
    return load(spark, sf_dir, "documents").select("doc_id", (F.array_sort(F.array("lang", "source")) == F.array_sort(values.unlisted(kinds))).alias("same"), kinds.alias("kinds"), F.size(values.unlisted(kinds)).cast("long").alias("n"))


# -- drawings ----------------------------------------------------------------------------------

#: Drawings put behind each document's first line, by turns.
ART = (
    "\n\n+----+----+\n| a | b |\n+----+----+\n| 1 | 2 |\n+----+----+\n", "\n\n    one -> two\n    two -> three\n", "\n\n```\n| 中文内容很长 |\n+----+\n```\n",
    "\n\n├── a\n│   └── b\n└── c\n", "\n\n#####\n#####\n#####\n", "\n\n```mermaid\nA --> B\nsubgraph x\nend\nend\nsubgraph y\nC<br/>D\n```\n", "\n\n```mermaid\ngraph TD\n",
)


def _art(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, ART)), (F.col("doc_id") % len(ART) + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), pick).alias("text"))


@register()
def ascii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_art.detect(_art(spark, sf_dir), "doc_id", "text")


@register()
def ascii_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _art(spark, sf_dir).select("doc_id", ascii_art.convert_drawings("text").alias("text"))


@register()
def border_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _art(spark, sf_dir).select("doc_id", ascii_art.repair_borders("text").alias("text"))


@register()
def mermaid_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _art(spark, sf_dir).select("doc_id", ascii_art.repair_mermaid("text").alias("text"))


@register("SELECT doc_id, doc_id % 7 IN (5)::INT AS blocks FROM documents".replace("doc_id % 7 IN (5)::INT", "(doc_id % 7 = 5)::BIGINT"))
def mermaid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole Mermaid blocks of each text, which a renderer would turn into pictures."""
    return _art(spark, sf_dir).select("doc_id", F.size(enhance.mermaid_blocks(F.col("text"))).cast("long").alias("blocks"))


@register("SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN 1 ELSE 0 END::BIGINT AS links, doc_id % 7 = 6 AS cut_off FROM documents")
def mermaid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in place of whole Mermaid blocks; blocks that are cut off stay."""
    linked = _art(spark, sf_dir).select("doc_id", enhance.with_image_links(F.col("text"), "images").alias("text"))
    return linked.select("doc_id", F.regexp_count("text", F.lit(r"!\[mermaid_[0-9a-f]{12}\.png\]\(images/mermaid_[0-9a-f]{12}\.png\)")).cast("long").alias("links"), F.col("text").contains("```mermaid").alias("cut_off"))


@register("SELECT doc_id, 'Write on ' || source || ' for ' || lang || ', keep {this}.' AS prompt FROM documents")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", enhance.filled_prompt(F.lit("Write on {title} for {query}, keep {this}."), title=F.col("source"), query=F.col("lang")).alias("prompt"))


@register(f"SELECT * FROM (UNPIVOT (SELECT doc_id, \"P0\", \"P1\", \"P2\", \"P3\" FROM ({oracle_sql()['lint_summary']})) ON \"P0\", \"P1\", \"P2\", \"P3\" INTO NAME level VALUE n) WHERE n > 0")
def lint_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by level through the SQL table function."""
    from scriptorium.functions import tables

    tables.register(spark)
    return spark.sql("SELECT doc_id, level, count(*) AS n FROM {docs}, LATERAL lint_text(text) GROUP BY doc_id, level", docs=_md(spark, sf_dir))


@register()
def page_dom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page by its tree of elements."""
    from scriptorium.operators import dom
    from scriptorium.tables import spread

    return dom.with_dom_text(spread(load(spark, sf_dir, "pages").select("page_id", "html")), "page_id")
