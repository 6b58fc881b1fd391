"""Line-level operators on Markdown: lint, sections, widths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.tables import small_batches


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): line_no from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def visual_width(text: Column) -> Column:
    """Code points, CJK and fullwidth ones twice."""
    return 2 * F.length(text) - F.length(F.regexp_replace(text, r"[\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]", ""))


def _per_text(docs: DataFrame, schema: str, rows_of: Callable[[list[str]], Iterator[tuple]]) -> DataFrame:
    """(doc_id, *schema): rows of each text's lines, in one Arrow pass without a shuffle; a null text has no lines."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for row in rows_of(text.split("\n")) if text is not None else ():
                    at.append(i)
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(own).mapInArrow(run, f"doc_id long, {schema}")


HEADING, SECTION = re.compile(r"(#{1,6})\s+\S"), re.compile(r"#{1,3}\s+\S")
DELIMITER, DELIMITER_LINE = re.compile(r"\|\s*[-:]+\s*\|"), re.compile(r"\|[\s\-:]+\|$")


def runs_of_blanks(lines: list[str], least: int = 5) -> Iterator[tuple[int, int]]:
    """(line_no, run) of blank lines that a later line with text closes."""
    at = 1
    for blank, group in groupby(lines, key=lambda x: not x.strip(" ")):
        n = sum(1 for _ in group)
        if blank and n >= least and at + n <= len(lines):
            yield at, n
        at += n


def jumps_of_headings(lines: list[str]) -> Iterator[tuple[int, int, int]]:
    """(line_no, level, before) of headings more than one level below the one before."""
    before = None
    for at, line in enumerate(lines, 1):
        if m := HEADING.match(line):
            level = len(m[1])
            if before is not None and level - before > 1:
                yield at, level, before
            before = level


def ragged_of_tables(lines: list[str]) -> Iterator[tuple[int, int]]:
    """(line_no, widest) of tables whose rows differ in their number of filled cells."""
    marks = [bool(DELIMITER.search(x)) for x in lines]
    at = 0
    for pipe, group in groupby(lines, key=lambda x: x.strip().startswith("|")):
        n = sum(1 for _ in group)
        if pipe:
            rows = [i for i in range(at, at + n) if not DELIMITER_LINE.match(lines[i].strip())]
            start = next((i for i in rows if any(marks[max(0, i - 5) : i + 5])), None)
            cells = [(i, sum(bool(c.strip()) for c in lines[i].split("|"))) for i in rows if start is not None and i >= start]
            if cells and min(c for _, c in cells) < max(c for _, c in cells):
                yield cells[0][0] + 1, max(c for _, c in cells)
        at += n


def cut_sections(lines: list[str]) -> Iterator[tuple[int, str, int, str]]:
    """(sec_no, title, line_start, digest): cut at headings of level 1 to 3, the preamble, if there is one, as section 0."""
    starts = [i for i, x in enumerate(lines) if SECTION.match(x)]
    cuts = ([] if starts[:1] == [0] else [(0, 0)]) + [(n, i) for n, i in enumerate(starts, 1)]
    for (number, i), (_, stop) in zip(cuts, [*cuts[1:], (0, len(lines))], strict=True):
        body = "\n".join(lines[i:stop])
        yield number, lines[i].lstrip("#").strip(" ") if number else "", i + 1, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def blank_runs(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, line_no, run): runs of blank lines that a later line with text closes; line_no is the run's first."""
    return _per_text(docs, "line_no long, run long", lambda x: runs_of_blanks(x, least))


def heading_gaps(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, before): headings more than one level below the one before."""
    return _per_text(docs, "line_no long, level long, before long", jumps_of_headings)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sec_no, title, line_start, digest): cut at headings of level 1 to 3, the preamble as section 0."""
    return _per_text(docs, "sec_no long, title string, line_start long, digest string", cut_sections)


def section_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc_id, title, change) of sections against a baseline; of equal titles the last counts."""
    last = lambda s: s.groupBy("doc_id", "title").agg(F.max_by("digest", "sec_no").alias("digest"))
    joined = last(new).join(last(old).withColumnRenamed("digest", "was"), ["doc_id", "title"], "left")
    return joined.select("doc_id", "title", F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("digest"), "modified").otherwise("unchanged").alias("change"))


def change_summary(changes: DataFrame) -> DataFrame:
    """(doc_id, new, modified, unchanged)."""
    return changes.groupBy("doc_id").agg(*(F.count_if(F.col("change") == c).cast("long").alias(c) for c in ("new", "modified", "unchanged")))


def ragged_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, widest): tables whose rows differ in their number of filled cells.

    A table is a run of lines that begin with a pipe, from the first row that has a delimiter
    line at most five lines before or four after it; delimiter lines aren't rows.
    """
    return _per_text(docs, "line_no long, widest long", ragged_of_tables)


def check_counts(text: Column, min_headings: int = 3, max_bytes: int = 10 << 20) -> tuple[Column, Column]:
    """(fatal, severe) findings: empty or too large; control characters, lines with box glyphs, too few headings. A fatal one ends the check."""
    fatal = (~text.rlike(r"\S") | (F.octet_length(text) > max_bytes)).cast("long")
    boxes = F.size(F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[│─┌┐└┘├┤┬┴┼〇]")))
    few = (F.regexp_count(text, F.lit(r"(?md)^#{1,2}\s+\S")) < min_headings).cast("long")
    severe = F.regexp_count(text, F.lit(r"[\x00-\x08\x0e-\x1b\x1f]")) + boxes + few
    return fatal, F.when(fatal > 0, F.lit(0)).otherwise(severe).cast("long")


def check_status(fatal: Column, severe: Column) -> Column:
    return F.when(fatal > 0, "blocked").when(severe > 0, "fail").otherwise("pass")


# How far a border looks back, how deep it may stand, how much deeper text ends the search, and by how much it must be narrower.
LOOK_BACK, MOST_INDENT, DEEPER, NARROWER = 50, 10, 5, 2
_WIDE = r"[\x{4e00}-\x{9fff}]"


def border_targets(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, width, target, narrow) of the borders inside fences: ``target`` is the width of the nearest line with Chinese text before it.

    None behind a fence, behind text that stands more than five columns deeper, or further than fifty lines. Windows over a text's lines only: the
    fences so far tell whether a line is inside, and the last line of each kind within the frame which is nearest. Each row of ``docs`` counts for itself.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    own = numbered.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    line = F.regexp_replace("line", "\r+$", "")
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    own = own.select("doc_id", "row", "at", bare.alias("bare"), (F.length(line) - F.length(F.ltrim(line))).alias("indent"))
    border = (F.length("bare") >= 5) & F.col("bare").contains("+") & F.col("bare").contains("-") & ~F.col("bare").contains("|") & ~F.col("bare").rlike(_WIDE)
    kind = F.when(F.col("bare").startswith("```"), "fence").when(F.col("bare") == "", "blank").when(border, "border").when(F.col("bare").rlike(_WIDE), "wide").otherwise("text")
    width = F.length("bare") + F.regexp_count("bare", F.lit(_WIDE)) + F.regexp_count("bare", F.lit(r"[\x{10000}-\x{10ffff}]"))
    own = own.withColumns({"kind": kind, "width": width})
    lines_of = Window.partitionBy("row").orderBy("at")
    so_far, before = lines_of.rowsBetween(Window.unboundedPreceding, 0), lines_of.rowsBetween(-LOOK_BACK, -1)
    last = lambda c: F.max(F.when(c, F.col("at"))).over(before)
    deeper = [last((F.col("kind") == "text") & (F.col("indent") > i + DEEPER)) for i in range(MOST_INDENT + 1)]
    own = own.withColumns({
        "inside": F.sum((F.col("kind") == "fence").cast("int")).over(so_far) % 2 == 1,
        "fence": last(F.col("kind") == "fence"),
        "deeper": F.array(*deeper),
        "wide": F.last(F.when(F.col("kind") == "wide", F.struct("at", "width")), True).over(before),
    })
    own = own.filter((F.col("kind") == "border") & F.col("inside") & (F.col("indent") <= MOST_INDENT))
    stop = F.greatest(F.coalesce("fence", F.lit(-1)), F.coalesce(F.element_at("deeper", F.col("indent") + 1), F.lit(-1)))
    target = F.when(F.col("wide.at") > stop, F.col("wide.width")).cast("long")
    own = own.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.col("width").cast("long").alias("width"), target.alias("target"))
    return own.withColumn("narrow", F.coalesce(F.col("width") < F.col("target") - NARROWER, F.lit(False)))
