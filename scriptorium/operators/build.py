"""Documents out of search rows and articles: skeleton, fill by TF-IDF, templates, references. One document a task.

All operators take many tasks at once: ``task`` is a column, and nothing is gathered but what one document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import rank, writer
from scriptorium.operators.enhance import escaped
from scriptorium.operators.search import BLANK, stripped
from scriptorium.tables import newest, stored

# Fixed values of the build rules.
SECTION_ORDER = ("概念原理", "技术教程", "实践应用", "对比分析", "最佳实践", "其他")
BOILERPLATE = "(?i)^(navigation|menu|footer|copyright|©|广告|推荐|热门|相关文章)"
LEAST_PARAGRAPH, MOST_PARAGRAPH, SIGNATURE, BEST, EXTRACTED = 40, 3000, 200, 8, 8
PLAIN_SKELETON = ("概述", "详细内容", "总结")
INTRO_WORDS, CORE_WORDS = ("介绍", "概述", "什么是"), ("概念", "定义", "原理", "机制")
PRACTICE_WORDS, END_WORDS = ("实践", "应用", "示例", "用法", "教程", "案例"), ("总结", "结论", "未来", "展望", "发展趋势")
NOT_CORE = ("的", "是", "在", "了")
EMPTY_SECTION, REFERENCES, CONTENTS = "*（暂无可用的相关内容）*", "## 参考资料", "## 目录"
TRANSITIONS = (
    ("简介", "核心概念", "了解了基本概念后，下面我们来深入分析其核心原理。"),
    ("核心概念", "详细分析", "理解了核心概念后，我们进一步探讨具体的技术细节。"),
    ("核心概念", "实践", "理论之外，实践应用同样值得关注。"),
    ("详细分析", "实践", "上面的分析为我们打下了基础，接下来看看实际应用。"),
    ("详细分析", "实践与应用", "技术原理之外，实际应用场景同样重要。"),
    ("实践", "总结", "综合以上讨论，我们可以做出以下总结。"),
    ("实践与应用", "总结", "回顾以上的实践内容，可以得出以下结论。"),
    ("", "", "接下来，我们继续探讨相关内容。"),
)
WORDS, LONG_WORDS = (rf"(?U)[\w\x{{4e00}}-\x{{9fff}}]{n}" for n in ("+", "{2,}"))


def ordered_articles(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` (task, url, relevance) with place: by relevance, then ``order``; of rows with one URL the first stays, rows without URL all do."""
    best = [F.coalesce("relevance", F.lit(0)).desc(), F.col(order)]
    key = F.when(F.coalesce("url", F.lit("")) == "", F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(F.col("url"))
    first = newest(rows, ["task", key], best, 1)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy(*best)))


def useful_paragraph(text: Column) -> Column:
    """Long enough and no boilerplate, by its first words."""
    return (F.length(text) >= LEAST_PARAGRAPH) & ~text.rlike(BOILERPLATE)


def cut_paragraph(text: Column) -> Column:
    return F.when(F.length(text) > MOST_PARAGRAPH, F.concat(F.left(text, F.lit(MOST_PARAGRAPH)), F.lit("..."))).otherwise(text)


def paragraphs_of(articles: DataFrame, split: str = rf"\n{BLANK}*\n") -> DataFrame:
    """(task, place, at, title, url, text): useful paragraphs of articles (task, place, title, url, text), equal beginnings once a task, the first in order."""
    own = articles.select("task", "place", "title", "url", F.posexplode(F.split("text", split, -1)).alias("at", "text"))
    own = own.withColumn("text", cut_paragraph(stripped(F.col("text")))).filter(useful_paragraph(F.col("text")))
    alike = Window.partitionBy("task", F.sha2(F.left("text", F.lit(SIGNATURE)), 256)).orderBy("place", "at")
    return own.withColumn("_n", F.row_number().over(alike)).filter("_n = 1").drop("_n")


def skeleton(tasks: DataFrame, articles: DataFrame) -> DataFrame:
    """(task, section, heading, keywords) of tasks (task, query): three plain sections without a query, else four, and a fifth where an article meets the query.

    Keywords of that one are the first EXTRACTED different words of the first thirty paragraphs (lines longer than 40) of each
    article that hold a word of the query, five words a paragraph, in order.
    """
    # A table, so that the planner knows how small it is and no line is shuffled by its task.
    words = stored(tasks.select("task", "query", F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(WORDS), 0).alias("words")), "words")
    lines = F.filter(F.transform(F.split("text", "\n", -1), stripped), lambda p: F.length(p) > LEAST_PARAGRAPH)
    own = articles.select("task", "place", F.posexplode(F.slice(lines, 1, 30)).alias("at", "line")).join(words, "task")
    met = own.filter(F.exists("words", lambda w: F.lower("line").contains(F.lower(w))))
    found = met.select("task", "place", "at", F.posexplode(F.slice(F.regexp_extract_all("line", F.lit(LONG_WORDS), 0), 1, 5)).alias("i", "word"))
    first = found.groupBy("task", "word").agg(F.min(F.struct("place", "at", "i")).alias("first"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("task").orderBy("first"))).filter(F.col("_n") <= EXTRACTED)
    extracted = first.groupBy("task").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "word"))), lambda x: x["word"]).alias("extracted"))
    row = lambda heading, keywords: F.struct(F.lit(heading).alias("heading"), keywords.alias("keywords"))
    fixed = lambda words: F.array(*map(F.lit, words))
    core = F.filter("words", lambda w: (F.length(w) > 1) & ~w.isin(*NOT_CORE))
    plan = F.filter(
        F.array(
            row("简介", F.concat(F.slice("words", 1, 3), fixed(INTRO_WORDS))),
            F.when(F.size(core) > 0, row("核心概念", F.concat(core, fixed(CORE_WORDS)))),
            F.when(F.col("extracted").isNotNull(), row("详细分析", F.col("extracted"))),
            row("实践与应用", fixed(PRACTICE_WORDS)),
            row("总结", fixed(END_WORDS)),
        ),
        lambda x: x.isNotNull(),
    )
    plain = F.array(*(row(h, F.array().cast("array<string>")) for h in PLAIN_SKELETON))
    whole = words.join(extracted, "task", "left").withColumn("plan", F.when(F.coalesce("query", F.lit("")) == "", plain).otherwise(plan))
    return whole.select("task", F.posexplode("plan").alias("section", "p")).select("task", "section", "p.heading", "p.keywords")


def fill(sections: DataFrame, paragraphs: DataFrame, most: int = BEST, least: float = 0.01, fallback: int = 3) -> DataFrame:
    """(task, section, rank, title, url, text): the best paragraphs of each section by TF-IDF cosine within the task.

    The first ``most`` paragraphs for a section without keywords, the first ``fallback`` where none is above ``least``. A
    paragraph that several sections choose goes to the first.
    """
    paras = stored(paragraphs.withColumn("id", F.struct("place", "at")), "paragraphs")
    keys = stored(sections.withColumn("keys", F.array_distinct(F.filter(F.transform("keywords", F.lower), lambda k: F.length(k) > 1))), "keys")
    asked = keys.select("task", "section", F.size("keys").alias("n_keys"), F.explode("keys").alias("term"))
    # Whatever no section asks for needs no weights, though its terms count: a few words a task, known in size to the planner.
    wanted = stored(asked.groupBy("task").agg(F.collect_set("term").alias("wanted")), "wanted")
    own = paras.select("task", "id", rank.tokens(F.col("text")).alias("words")).join(wanted, "task").filter(F.arrays_overlap("words", "wanted"))
    total = stored(paras.groupBy("task").agg(F.count(F.lit(1)).alias("total")), "totals")
    df = paras.select("task", F.explode(F.array_distinct(rank.tokens(F.col("text")))).alias("term")).groupBy("task", "term").agg(F.count(F.lit(1)).alias("df")).join(total, "task")
    idf = df.select("task", "term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    terms = rank.with_terms(own).select("task", "id", "term", "tf", F.array_contains("wanted", F.col("term")).alias("hit"))
    weights = terms.join(idf, ["task", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    met = weights.groupBy("task", "id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), F.collect_list(F.when(F.col("hit"), F.struct("term", "w"))).alias("hits"))
    hits = met.select("task", "id", "norm", F.inline("hits")).join(asked, ["task", "term"]).groupBy("task", "section", "id").agg(F.sum("w").alias("dot"), F.max("norm").alias("norm"), F.max("n_keys").alias("n_keys"))
    scored = hits.select("task", "section", "id", (F.col("dot") / (F.col("norm") * F.sqrt("n_keys"))).alias("score")).filter(F.col("score") > least)
    best = Window.partitionBy("task", "section").orderBy(F.round("score", 9).desc(), "id")
    chosen = stored(scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("task", "section", "id", "rank"), "chosen")
    bare = keys.select("task", "section", F.when(F.size("keywords") == 0, most).otherwise(fallback).alias("some")).join(chosen.select("task", "section").distinct(), ["task", "section"], "left_anti")
    order = Window.partitionBy("task").orderBy("id")
    # No section takes more than ``most`` of them; the limit runs before the shuffle.
    first = paras.select("task", "id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(most, fallback))
    chosen = chosen.unionByName(bare.join(first, "task").filter("rank <= some").select("task", "section", "id", "rank"))
    own = stored(newest(chosen, ["task", "id"], ["section"], 1), "owned")
    return own.join(paras.select("task", "id", "title", "url", "text"), ["task", "id"]).select("task", "section", "rank", "title", "url", "text")


def _joined(items: Column, between: str = "\n") -> Column:
    return F.array_join(items, between)


def article_document(tasks: DataFrame, articles: DataFrame) -> DataFrame:
    """(task, content): a document for each of tasks (task, title, query) from its articles (task, place, title, url, text).

    Heading, contents, a section for each heading of the skeleton with its paragraphs, and each referred URL once in the
    order of use. A task without articles has empty sections. Times of day are left to the caller.
    """
    plan = stored(skeleton(tasks, articles), "skeleton")
    filled = fill(plan, paragraphs_of(articles))
    bodies = filled.groupBy("task", "section").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "title", "url"))).alias("rows"))
    parts = plan.select("task", "section", "heading").join(bodies, ["task", "section"], "left")
    body = F.when(F.size("rows") > 0, F.concat(_joined(F.transform("rows", lambda r: r["text"]), "\n\n"), F.lit("\n"))).otherwise(F.lit(EMPTY_SECTION + "\n"))
    text = F.concat(F.lit("## "), "heading", F.lit("\n\n"), body, F.lit("\n---\n"))
    refs = F.transform(F.coalesce("rows", F.array().cast("array<struct<rank:int,text:string,title:string,url:string>>")), lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title")))
    whole = parts.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("section", "heading", text.alias("text"), refs.alias("refs")))).alias("s"))
    every = F.filter(F.flatten(F.transform("s", lambda x: x["refs"])), lambda r: F.coalesce(r["url"], F.lit("")) != "")
    urls = F.transform(every, lambda r: r["url"])
    once = F.filter(every, lambda r, i: F.array_position(urls, r["url"]) == i + 1)
    listed = F.transform(once, lambda r: F.concat(F.lit("- ["), r["title"], F.lit("]("), r["url"], F.lit(")")))
    contents = F.transform("s", lambda x: F.concat(F.lit("1. ["), x["heading"], F.lit("](#"), x["heading"], F.lit(")")))
    topic = F.when(F.coalesce("query", F.lit("")) != "", F.concat(F.lit("> 主题: "), "query", F.lit("\n"))).otherwise("")
    end = F.when(F.size(listed) > 0, F.concat(F.lit(f"\n{REFERENCES}\n\n"), _joined(listed), F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("# "), "title", F.lit("\n\n"), topic, F.lit(f"\n{CONTENTS}\n\n"), _joined(contents), F.lit("\n\n---\n\n"), _joined(F.transform("s", lambda x: x["text"])), end)
    return tasks.join(whole, "task").select("task", content.alias("content"))


def chunk_document(chunks: DataFrame, order: str) -> DataFrame:
    """(task, content) of chunks (task, title, content, url): each title's first chunk, in the order of sections, then references.

    The default template: heading, sections, rule, references with Markdown characters escaped.
    """
    key = F.left(F.lower(stripped(F.coalesce("title", F.lit("")))), F.lit(50))
    own = chunks.withColumn("_k", key).filter("_k <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("task", "_k").orderBy(order))).filter("_n = 1")
    own = own.withColumn("section", writer.section_of(F.concat_ws(" ", "title", "content")))
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section"))
    block = F.concat(F.lit("### "), "title", F.lit("\n\n"), "content")
    ref = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("- ["), escaped(F.col("title")), F.lit("]("), escaped(F.col("url")), F.lit(")")))
    rows = own.groupBy("task", place.alias("place"), "section").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("block"), ref.alias("ref")))).alias("rows"))
    section = F.concat(F.lit("## "), "section", F.lit("\n\n"), _joined(F.transform("rows", lambda r: r["block"]), "\n\n"), F.lit("\n\n"))
    refs = F.filter(F.transform("rows", lambda r: r["ref"]), lambda r: r.isNotNull())
    whole = rows.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("place", section.alias("text"), refs.alias("refs")))).alias("s"))
    return whole.select("task", rendered(F.transform("s", lambda x: x["text"]), F.flatten(F.transform("s", lambda x: x["refs"]))).alias("body"))


def rendered(sections: Column, references: Column) -> Column:
    """The default template behind its heading: sections, a rule, the list of references."""
    return F.concat(_joined(sections), F.lit(f"\n\n---\n\n{REFERENCES}\n\n"), _joined(references), F.lit("\n"))


def transition(before: Column, after: Column) -> Column:
    """The sentence between two headings: the first template whose names hold, or are held by, both; the last template fits all."""
    fits = lambda name, heading: F.contains(heading, F.lit(name)) | F.contains(F.lit(name), heading)
    choice = F
    for a, b, text in TRANSITIONS:
        choice = choice.when(fits(a, before) & fits(b, after), text)
    return choice


def with_transitions(text: Column) -> Column:
    """``text`` with a quoted sentence in front of each ``##`` section but the first that has a hundred characters or more."""
    parts = F.split(text, r"\n(?=##\s)", -1)
    heading = lambda x: stripped(F.regexp_extract(x, r"(?m)^##\s+([^\n]+)", 1))

    def one(part: Column, i: Column) -> Column:
        bare = stripped(part)
        before = heading(F.get(parts, i - 1))
        return F.when((F.length(bare) < 100) | (i == 0), bare).otherwise(F.concat(F.lit("> "), transition(before, heading(bare)), F.lit("\n\n"), bare))

    return _joined(F.transform(parts, one))


def tidy_references(text: Column, title: Column) -> Column:
    """Without empty sections of references; with its heading in front."""
    text = F.regexp_replace(text, rf"\n{REFERENCES}\n{BLANK}*\z", "")
    text = stripped(F.regexp_replace(text, rf"\n{REFERENCES}{BLANK}*\n(?=## )", "\n"))
    head = F.concat(F.lit("# "), title)
    return F.when(text.startswith(head), text).otherwise(F.concat(head, F.lit("\n\n"), text))


# -- three passes: search, plan, write ---------------------------------------------------------

#: Least and most characters of an article.
ARTICLE_CHARS = (200, 10_000)


def usable_articles(articles: DataFrame, text: str = "text") -> DataFrame:
    """Articles longer than 200 characters, cut to 10,000."""
    least, most = ARTICLE_CHARS
    return articles.filter(F.length(text) > least).withColumn(text, F.left(text, F.lit(most)))


def simple_text(html: Column) -> Column:
    """Text of a page without scripts, styles and page parts; tags and white space to blanks, five references decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        text = F.replace(text, F.lit(name), F.lit(char))
    return stripped(F.regexp_replace(text, f"{BLANK}+", " "))


def three_pass_document(articles: DataFrame, topic: list[str], title: str) -> DataFrame:
    """(content): the fixed plan's sections with the three best paragraphs of all usable articles (order, text); a notice where there is none."""
    own = usable_articles(articles).select("order", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("order", "i", stripped(F.col("line")).alias("text")).filter("length(text) > 50")
    best = writer.section_paragraphs(own, ["order", "i"], topic)
    order = F.struct((-F.col("score")).alias("minus"), "order", "i", "text")
    bodies = best.groupBy("section").agg(F.transform(F.sort_array(F.collect_list(order)), lambda r: r["text"]).alias("rows"))
    plan = articles.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(writer.PLAN)], "section int, heading string")
    text = F.concat(F.lit("## "), "heading", F.lit("\n\n"), F.coalesce(_joined(F.col("rows"), "\n\n"), F.lit(EMPTY_SECTION)), F.lit("\n"))
    # Six rows, the sections of the plan.
    whole = plan.join(bodies, "section", "left").agg(F.sort_array(F.collect_list(F.struct("section", text.alias("text")))).alias("s"))
    return whole.select(F.concat(F.lit(f"# {title}\n\n"), _joined(F.transform("s", lambda x: x["text"]))).alias("content"))
