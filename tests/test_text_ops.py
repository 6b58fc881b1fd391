import html
import re
from itertools import groupby

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium import catalog, tables
from scriptorium.functions import values
from scriptorium.operators import ascii_art, build, convert, dom, extract, layout, lint, monitor, quality, rank, search, sections, serp


def one(spark, column, **cells):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first().x


# -- search ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("raw", "clean"), [("a — b", "a  -  b"), ("**x*y** z", "x*y z"), ("[t [u]](http://a(b))", "t [u])"), ("1. **词**", "词"), ("- item", "item"), ("　a　", "a")])
def test_clean_query(spark, raw, clean):
    assert one(spark, search.clean_query(F.col("q")), q=raw) == clean


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("http://a/b?utm_source=x&q=%E4%BD%A0+b&e=#f", "http://a/b?q=你 b#f"), ("http://a/b?ref=1", "http://a/b"), ("http://a/b?=v&x=%zz", "http://a/b?=v&x=%zz"), ("?", "?")],
)
def test_normalize_url(spark, raw, clean):
    assert one(spark, search.normalize_url(F.col("u")), u=raw) == clean


def test_dedup_is_on_normalised_urls(spark):
    rows = [(1, "http://a/b?utm_source=x#f", "One"), (2, "http://a/b?utm_source=y#f", "Two"), (3, "http://a/b?id=1", "Three"), (4, "", ""), (5, "http://c", " three ")]
    df = spark.createDataFrame(rows, "pos long, url string, title string")
    assert sorted(r.pos for r in search.first_of_each(df).collect()) == [1, 3, 4]


def test_query_tokens_and_relevance(spark):
    assert sorted(one(spark, search.query_tokens(F.col("q")), q="核心架构与生产实践系统 The Kafka of")) == sorted(["核心架构", "生产实践系统", "生产", "产实", "实践", "践系", "系统", "kafka"])
    assert one(spark, search.query_relevance(F.lit("Kafka notes"), F.lit(None).cast("string"), F.col("q")), q="kafka streams") == 0.5
    assert one(spark, search.query_relevance(F.lit("x"), F.lit("y"), F.col("q")), q="of the") == 0.5


def test_hooks_tokens_and_backoff(spark):
    match = lambda event, pattern: one(spark, monitor.hook_matches(F.col("e"), F.col("p")), e=event, p=pattern)
    assert match("task.created", "task.*") and match("task.created", "*") and match("a", "a")
    assert not match("task", "task.*") and not match("tasks.x", "task.*") and not match("signup", "sign*")
    assert [one(spark, monitor.token_estimate(F.col("t")), t=t) for t in ("hello world", "你好世界", "")] == [3, 3, 0]
    assert one(spark, F.array(*(monitor.backoff(k, F.col("a"), 2.0) for k in ("exponential", "linear", "fixed"))), a=4) == [16.0, 8.0, 2.0]


# -- pages and documents -----------------------------------------------------------------------


def test_first_region_counts_and_the_plan_holds_a_page_once(spark):
    body = "a paragraph with more than thirty characters in it, and then some more of them " * 4
    page = f"<main><p>{body}</p><article><p>only a short one of thirty characters</p></article></main>"
    assert one(spark, extract.page_text(F.col("h")), h=page).startswith(body.strip())
    for name in ("page_extract_text", "page_extract_rank", "page_usable_filter", "fetch_stats"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("script|style") == 1, name


def as_html(text):
    """An independent renderer: fences by one regular expression, then lines by prefix."""
    def inline(x):
        for p, r in ((r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"), (r"`(.+?)`", r"<code>\1</code>"), (r"\[(.+?)\]\((.+?)\)", r'<a href="\2">\1</a>')):
            x = re.sub(p, r, x)
        return x

    out, table = [], False
    for piece in re.findall(r"(?ms)^[ \t]*```[^\n]*\n?(?:.*?^[ \t]*```[^\n]*$|.*\Z)|^[^\n]*$", text):
        bare = piece.strip()
        if bare.startswith("```"):
            code = piece.split("\n")
            out += [f'<pre><code class="language-{code[0].strip()[3:].strip()}">', *(html.escape(x, quote=False) for x in code[1:-1]), "</code></pre>"]
            continue
        heading = re.match(r"#{1,6}(?=\s)", piece)
        if table and not bare.startswith("|") and not heading:
            out, table = [*out, "</tbody></table>"], False
        if heading:
            out.append(f"<h{heading.end()}>{inline(piece[heading.end():].lstrip())}</h{heading.end()}>")
        elif bare.startswith("|"):
            cells = [inline(c.strip()) for c in piece.split("|")[1:-1]]
            if any(not re.fullmatch("[-:]+", c) for c in cells):
                row = "".join(f"<t{'d' if table else 'h'}>{c}</t{'d' if table else 'h'}>" for c in cells)
                out.append(f"<tr>{row}</tr>" if table else f"<table><thead><tr>{row}</tr></thead><tbody>")
                table = True
        elif re.match(r"\s*[-*+]\s", piece):
            out.append(f"<li>{inline(bare[1:].lstrip())}</li>" if bare[1:] else f"<p>{inline(piece)}</p>")
        elif bare.startswith(">"):
            out.append(f"<blockquote>{inline(bare[1:].strip())}</blockquote>")
        elif re.fullmatch(r"---+\s*", piece):
            out.append("<hr>")
        else:
            out.append(f"<p>{inline(piece)}</p>" if bare else "")
    return "\n".join([*out, *["</tbody></table>"] * table])


def patched(old, diff):
    """``old`` after a unified diff."""
    lines, out, at = old.splitlines(), [], 0
    for row in diff.split("\n")[2:]:
        if row.startswith("@@"):
            start, count = (re.match(r"@@ -(\d+)(?:,(\d+))?", row)).groups()
            start = int(start) - (count != "0")
            out += lines[at:start]
            at = start
        elif row.startswith("+"):
            out.append(row[1:])
        else:
            assert lines[at] == row[1:]
            out += [] if row.startswith("-") else [lines[at]]
            at += 1
    return out + lines[at:]


def test_html_and_diff_queries(spark, sf):
    texts = {r.doc_id: r.text for r in catalog._md(spark, sf).collect()}
    got = catalog.queries()["md_to_html"](spark, sf).collect()
    assert len(got) == len(texts) and all(r.html == as_html(texts[r.doc_id]) for r in got)
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    diffs = catalog.queries()["version_diff"](spark, sf).collect()
    assert len(diffs) == len(old) and all(patched(old[r.doc_id], r.diff) == texts[r.doc_id].splitlines() for r in diffs)
    sample = "| a | b |\n|-|-|\n# **h**\n| 1 | *2* |\nend `c`\n```py\n| x |\na<b\n```\n- i\n  > q\n---\n"
    assert convert.html_body(sample) == as_html(sample)


def test_transitions_and_references(spark):
    assert one(spark, build.transition(F.col("a"), F.col("b")), a="核心概念", b="实践与应用") == "理论之外，实践应用同样值得关注。"
    assert one(spark, build.transition(F.col("a"), F.col("b")), a="x", b="y") == build.TRANSITIONS[-1][2]
    long = "words " * 30
    got = one(spark, build.with_transitions(F.col("t")), t=f"# T\n\n## 简介\n\n{long}\n## 核心概念\n\n{long}\n## 总结\n\nshort")
    assert got.count("> ") == 2 and got.endswith("## 总结\n\nshort") and "> 了解了基本概念后" in got
    assert one(spark, build.tidy_references(F.col("t"), F.lit("T")), t="x\n## 参考资料\n") == "# T\n\nx"


def test_article_document_by_hand(spark):
    tasks = spark.createDataFrame([(1, "T", "kafka"), (2, "U", "")], "task long, title string, query string")
    text = "kafka keeps records of all that was sent to it, in order\n\ncopyright of somebody or other who wrote all of this down\n\nanother paragraph about the weather in the mountains"
    articles = spark.createDataFrame([(1, 1, "A", "http://a", text), (1, 2, "B", "http://b", text)], "task long, place long, title string, url string, text string")
    got = {r.task: r.content for r in build.article_document(tasks, articles).collect()}
    assert got[1].startswith("# T\n\n> 主题: kafka\n\n## 目录\n\n1. [简介](#简介)\n1. [核心概念]") and got[1].count("kafka keeps") == 1 and "copyright" not in got[1]
    assert got[1].endswith("## 参考资料\n\n- [A](http://a)\n") and build.EMPTY_SECTION in got[1]
    assert got[2].count(build.EMPTY_SECTION) == 3


# -- quality -----------------------------------------------------------------------------------

WATERY = "# 标题\n\n" + "\n\n".join(["我们可以通过这个方式，由于这个原因，因此我们可以的的的了是在和与及。这是一种方式，以及那个方式的的"] * 6)
GOOD = (
    "# Python 并发编程\n\n## 目录\n\n- 线程\n- 进程\n\n## 线程模型\n\nPython 3.12 的线程受全局解释器锁约束，CPU 密集任务在 8 核机器上最多使用 1 个核心，I/O 密集任务不受影响。\n\n"
    "```python\nimport threading\n```\n\n## 进程模型\n\nmultiprocessing 启动独立解释器，进程间用管道传输 pickle 数据，每次传输约 20 微秒，适合粒度超过 10 毫秒的任务。\n\n"
    "## 协程\n\nasyncio 在单线程内调度协程，单机可维持 10000 个连接，见 [文档](https://docs.python.org/3/library/asyncio.html)。\n\n"
    "## 参考资料\n\n- [threading](https://docs.python.org/3/library/threading.html)\n" + "- 线程池大小建议为核心数的 5 倍，队列长度 1000，超时 30 秒。\n" * 12
)


def test_gate_rejects_watery_and_passes_good(spark):
    docs = spark.createDataFrame([(0, WATERY), (1, GOOD)], "n long, text string")
    bad, good = quality.Profile().verdict(docs, "text", ["Python"], F.lit(0)).orderBy("n").collect()
    assert bad.overall < 70 and bad.needs_regenerate and bad.can_regenerate
    assert good.overall >= 70 and not good.needs_regenerate and not good.can_regenerate
    profile = quality.Profile.of({"weights": {}, "threshold": 10, "style_rules": []}, threshold=99)
    assert profile.threshold == 99 and profile.rules == () and profile.weights


# -- lint --------------------------------------------------------------------------------------


def test_findings_have_places():
    text = "# A\n### C\nx\x07y\n│\n```yaml\na: [1\n```\n" + "\n" * 6 + "| a | b |\n|---|---|\n| 1 |\n"
    got = {f[:4] for f in lint.findings(text)}
    assert {("P1", "control_char", 3, 2), ("P1", "unicode_border", 4, 0), ("P1", "yaml_syntax", 6, 0), ("P1", "structure", 0, 0), ("P2", "empty_lines", 8, 0), ("P3", "heading_gap", 2, 0), ("P3", "table_columns", 14, 0)} <= got
    assert list(lint.findings(" \n")) == [("P0", "content", 0, 0, "empty")] and list(lint.findings(None))[0][0] == "P0"
    assert ("P3", "yaml_comment") in {f[:2] for f in lint.findings("```yaml\na: b: c # d\n```")}
    assert not [f for f in lint.findings("```yaml\n{a\n```\n```yaml\nGET /x\n a: [\n```") if f[1].startswith("yaml")]


def test_rules_of_a_file():
    rules = lint.Rules.of({"structure": {"params": {"docker_min": 2}}, "missing_sections": {"enabled": False}, "size": {"params": {"max_size_mb": 0.00001}}})
    assert list(lint.findings("# A\n# B\n" + "x" * 20, "my-docker", rules)) == [("P0", "size", 0, 0, "too large")]
    rules = lint.Rules.of({"structure": {"params": {"docker_min": 2}}, "missing_sections": {"enabled": False}})
    assert not list(lint.findings("# A\n# B", "my-docker", rules)) and list(lint.findings("# A\n# B", "k8s", rules))[0][4] == "2 of 10 headings"


# -- drawings ----------------------------------------------------------------------------------


def kind_of(lines):
    """The first class whose measure is large enough, if it is sure enough: counts over all lines at once."""
    glyphs = set("".join(lines)) - set(" \t\n\r")
    count = lambda test: sum(bool(test(x)) for x in lines)
    box, odd = len(glyphs & ascii_art.BOX), len(glyphs - ascii_art.PLAIN)
    trees, tables = count(ascii_art.TREE_LINE.match), count(ascii_art.TABLE_LINE.match)
    arrows, arrow_lines = sum(map("".join(lines).count, ascii_art.ARROWS)), count(ascii_art.ARROW_LINE.search)
    banners, indented = count(lambda x: ascii_art.BANNER_LINE.match(x.strip())), count(re.compile(" {4}|\t").match)
    table = [
        ("box_drawing", box >= 3 and box > 0.3 * len(glyphs), box / 10),
        ("tree", trees >= 2 and trees > len(lines) / 2, trees / 10),
        ("table", tables >= 2, tables / 5),
        ("flowchart", max(arrows, arrow_lines) >= 2, (arrows + arrow_lines) / 10),
        ("banner", banners >= 3, banners / 8),
        ("code_block", indented >= 2 and indented > 0.7 * len(lines), indented / 10),
        ("diagram", odd >= 3 and len(lines) >= 2, min(odd / 15, 0.6)),
    ]
    return next((kind if sure > 0.2 else None for kind, fits, sure in table if fits), None)


def brute_drawings(text):
    """All ends of each run of lines with text; of those that are drawings the longest. It takes in the blank lines before a whole run."""
    lines, out, last = text.split("\n"), [], 0
    for filled, run in groupby(range(len(lines)), key=lambda i: bool(lines[i].strip())):
        run = list(run)
        if filled:
            ends = [(i, kind_of(lines[i : run[-1] + 1])) for i in run[:-1]]
            out += [(kind, last if i == run[0] else i, run[-1]) for i, kind in ends if kind][:1]
            last = run[-1] + 1
    return out


def test_drawings(spark, sf):
    art = catalog.queries()["ascii_detect"](spark, sf)
    from scriptorium.catalog_text import _art

    texts = {r.doc_id: r.text for r in _art(spark, sf).collect()}
    got = {}
    for r in art.collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.start, r.stop))
    assert all(sorted(got.get(d, [])) == sorted(brute_drawings(t)) for d, t in texts.items())
    kinds = lambda t: [d.kind for d in ascii_art.drawings(t)]
    assert kinds("┌──┐\n│ab│\n└──┘") == ["box_drawing"] and kinds("├── a\n├── b\n└── c") == ["box_drawing"] and kinds("+--+\n| a |\n+--+") == ["table"]
    assert kinds("a → b → d\nb → c") == ["flowchart"] and kinds("####\n####\n####") == ["banner"] and kinds("plain words\nmore words") == [] and kinds(None or "") == []


def test_conversions():
    assert ascii_art.converted("+---+---+\n| a | b |\n+---+---+\n| 1 |\n+---+---+\nx") .startswith("| a | b |\n| --- | --- |\n| 1 |  |")
    assert "0(one) --> 1(two)" in ascii_art.converted("one -> [two]\n→ three → four")
    assert ascii_art.converted("plain") == "plain" and ascii_art.converted(None) == ""
    assert ascii_art.boxed("+-|") == "```\n┼─│\n```"


def test_borders():
    text = "+----+\n```\n中文内容很长的一行\n  +----+\n+-----------------+\n```\n+----+"
    assert ascii_art.repaired_borders(text).split("\n")[3] == "  +" + "-" * 16 + "+" and ascii_art.repaired_borders(text).split("\n")[4] == "+-----------------+"
    assert ascii_art.repaired_borders(text).split("\n")[6] == "+----+" and ascii_art.width("中a😀") == 5
    assert ascii_art.repaired_borders("```\n中文内容很长\r\n+----+\r\n```") == "```\n中文内容很长\r\n+----------+\r\n```"


def test_mermaid():
    assert ascii_art.repaired_mermaid("```mermaid\nA --> B<br/>\nend\n```") == "```mermaid\ngraph TD  A --> B<br>\n```"
    assert ascii_art.repaired_mermaid("```mermaid\ngraph LR\nsubgraph a\nB\n```\nx") == "```mermaid\ngraph LR\nsubgraph a\nB\n    end\n```\nx"
    assert ascii_art.repaired_mermaid("text\n```mermaid\ngraph") == "text" and ascii_art.repaired_mermaid(None) == ""


# -- sections and values -----------------------------------------------------------------------


def test_sections_come_together_again(spark):
    texts = ["", "plain", "## A", "## A\n", "x\n\n## A\nbody\n### B\nmore\n## C", "## A\n### B\n" + "y" * 400 + "\n### C\nz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = sections.split(docs)
    got = {r.doc_id: r.text for r in sections.joined(own, sections.chunks(own, 50)).collect()}
    assert got == dict(enumerate(texts))


def test_enhancing_is_guarded(spark):
    body = "## A\n" + "some words that are long enough to be rewritten by it " * 2
    docs = spark.createDataFrame([(0, body), (1, body + "\n```\ncode\n```"), (2, "## A\nshort")], "doc_id long, text string")
    out = {r.doc_id: r for r in sections.enhanced(docs, lambda t: F.concat(F.upper(F.replace(t, F.lit("\n```"), F.lit(""))), F.lit("\n优化后的内容"))).collect()}
    assert out[0].text == "## A\n" + body[5:].upper() and out[0].changed and not out[1].changed and not out[2].changed
    assert not any(r.changed for r in sections.enhanced(docs, lambda t: F.lit(None).cast("string")).collect())


def test_values():
    assert values.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    assert [values.literal(x) for x in ("Yes", "off", " 7 ", "1.5", "x")] == [True, False, 7, 1.5, "x"]


def test_dom_text(spark, sf):
    body = "a paragraph with more than thirty characters in it"
    page = f"<head><title>t</title></head><nav>menu menu menu menu menu menu menu menu</nav><article><h1>short</h1><p>{body} &amp; more<p>{body} <b>bold</b></article><p>{body} outside"
    assert dom.dom_text(page.replace("short", "short" * 30)) == "short" * 30 + f"\n{body} & more\n{body} bold"
    assert dom.dom_text(page).startswith("short " + body) and "outside" in dom.dom_text(page) and "menu" not in dom.dom_text(page)
    assert dom.dom_text(None) == dom.dom_text("") == "" and dom.dom_text("<div>" * 3000 + "deep") == "deep"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in catalog.queries()["page_dom_text"](spark, sf).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        paragraphs = [" ".join(html.unescape(re.sub("<[^>]+>", "\n", x)).split()) for x in re.split("<p>|<h1>", article)]
        long = [x for x in paragraphs if len(x) >= 30]
        if sum(map(len, long)) >= 200:
            assert [" ".join(x.split()) for x in r.text.split("\n") if len(x) >= 30] == long


# -- bounded batches ---------------------------------------------------------------------------


def sizes_of_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])


def largest_batch(spark, operator):
    """Bytes of the largest Arrow batch of forty texts of 400,000 characters each, in the session as ``operator`` leaves it."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 80_000).alias("text"))
    operator(texts)
    return max(r.n for r in texts.mapInArrow(sizes_of_batches, "n long").collect())


def test_result_pages_come_in_small_batches(spark):
    assert largest_batch(spark, lambda t: serp.context_rows(t, "doc_id", "text")) < 2 * tables.BATCH_BYTES


def test_documents_come_in_small_batches(spark):
    assert largest_batch(spark, layout.sections) < 2 * tables.BATCH_BYTES
    assert largest_batch(spark, lint.check) < 2 * tables.BATCH_BYTES
    assert largest_batch(spark, lambda t: ascii_art.detect(t, "doc_id", "text")) < 2 * tables.BATCH_BYTES


# -- terms -------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_within_rows(spark):
    texts = spark.createDataFrame([(1, "bb aa bb cc bb a"), (2, ""), (3, None), (4, "一二 一二"), (5, "zz")], "para_id long, text string")
    got = rank.with_terms(texts)
    assert {(r.para_id, r.term): r.tf for r in got.collect()} == {(1, "aa"): 1 / 3, (1, "bb"): 1.0, (1, "cc"): 1 / 3, (4, "一二"): 1.0, (5, "zz"): 1.0}
    # No table of terms by paragraph: neither in the counts nor before the sums of a paragraph.
    assert "Exchange" not in plan_of(got) and "Aggregate" not in plan_of(got)
    weights = spark.createDataFrame([("aa", 2.0), ("bb", 1.0)], "term string, idf double")
    assert "hashpartitioning(para_id" not in plan_of(rank.scores(texts, ["aa"], F.broadcast(weights))).split("HashAggregate")[-1]
