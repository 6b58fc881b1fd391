"""Findings of Markdown texts with their places, by rules that a YAML file may set. One Arrow pass a text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import layout
from scriptorium.tables import small_batches

try:
    import yaml
except ImportError:
    yaml = None

# Fixed values of the rules.
BOXES = re.compile("[│─┌┐└┘├┤┬┴┼〇]")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
HEADING = re.compile(r"(?m)^#{1,2}\s+\S")
FENCE = re.compile(r"```yaml\s*\n(.*?)\n```", re.S | re.I)
REST, COMMENTED = re.compile(r"\b(PUT|POST|GET|DELETE)\s+[/_]"), re.compile(r":\s*\w.*#")
LEAST_HEADINGS = (("kubernetes", "k8s_min", 10), ("k8s", "k8s_min", 10), ("docker", "docker_min", 6), ("mysql", "mysql_min", 8), ("", "default_min", 3))
MISSING = (("faq", re.compile("常见问题|FAQ", re.I)), ("practice", re.compile("最佳实践|best.practice", re.I)), ("trouble", re.compile("故障排查|troubleshoot", re.I)))
LEVELS = ("P0", "P1", "P2", "P3")


@dataclass(frozen=True)
class Rules:
    """Which rules are on (all that aren't named off), and their numbers, as a YAML file of rules gives them."""

    off: frozenset[str] = frozenset()
    params: dict[str, dict[str, Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, rules: Mapping[str, Any]) -> Rules:
        """From ``{category: {enabled: bool, params: {...}}}``."""
        own = {k: v or {} for k, v in rules.items()}
        return cls(frozenset(k for k, v in own.items() if not v.get("enabled", True)), {k: dict(v.get("params") or {}) for k, v in own.items()})

    def on(self, name: str) -> bool:
        return name not in self.off

    def param(self, name: str, key: str, default: Any) -> Any:
        return self.params.get(name, {}).get(key, default)


Finding = tuple[str, str, int, int, str]


def _fences(text: str) -> Iterator[Finding]:
    for m in FENCE.finditer(text) if yaml else ():
        body = m[1]
        heads = [x.strip() for x in body.strip().split("\n")[:5]]
        if any(x.startswith("{") for x in heads) or REST.search(body):
            continue
        try:
            list(yaml.safe_load_all(body))
        except yaml.YAMLError as problem:
            said, line = str(problem), text.count("\n", 0, m.start(1)) + 1
            comment = "mapping values are not allowed" in said and "#" in body[:200] and COMMENTED.search(body[:300])
            yield ("P3", "yaml_comment", line, 0, "inline comment") if comment else ("P1", "yaml_syntax", line, 0, said[:80])


def findings(text: str | None, name: str = "", rules: Rules = Rules()) -> Iterator[Finding]:
    """(level, category, line, column, detail); 0 where a finding has no place. A fatal one ends the check."""
    text = text or ""
    if not text.strip():
        yield "P0", "content", 0, 0, "empty"
        return
    if len(text.encode("utf-8", "surrogatepass")) > rules.param("size", "max_size_mb", 10) * 1024 * 1024:
        yield "P0", "size", 0, 0, "too large"
        return
    lines = text.split("\n")
    for at, line in enumerate(lines, 1):
        if rules.on("control_char"):
            yield from (("P1", "control_char", at, m.start() + 1, f"\\x{ord(m[0]):02x}") for m in CONTROL.finditer(line))
        if rules.on("unicode_border") and (glyphs := BOXES.findall(line)):
            yield "P1", "unicode_border", at, 0, "".join(glyphs)
    if rules.on("yaml_syntax"):
        yield from _fences(text)
    if rules.on("structure"):
        _, key, default = next(x for x in LEAST_HEADINGS if x[0] in name.lower())
        least, found = rules.param("structure", key, default), len(HEADING.findall(text))
        if found < least:
            yield "P1", "structure", 0, 0, f"{found} of {least} headings"
    if rules.on("empty_lines"):
        least = rules.param("empty_lines", "max_consecutive", 5)
        yield from (("P2", "empty_lines", at, 0, str(n)) for at, n in layout.runs_of_blanks(lines, least))
    if rules.on("heading_gap"):
        yield from (("P3", "heading_gap", at, 0, f"{before} to {level}") for at, level, before in layout.jumps_of_headings(lines))
    if rules.on("table_columns"):
        yield from (("P3", "table_columns", at, 0, str(n)) for at, n in layout.ragged_of_tables(lines))
    if rules.on("missing_sections"):
        yield from (("P3", "missing_sections", 0, 0, section) for section, pattern in MISSING if not pattern.search(text))


def check(docs: DataFrame, name: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, level, category, line, column, detail) of docs (doc_id, text); ``name``: a column with file names, which say how many headings are due."""
    names = ("doc_id", "level", "category", "line", "column", "detail")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, of) in enumerate(zip(batch.column("text").to_pylist(), batch.column("of").to_pylist(), strict=True)):
                for row in findings(text, of or "", rules):
                    at.append(i)
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=list(names))

    of = (F.col(name) if name else F.lit("")).cast("string").alias("of")
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), of)).mapInArrow(run, "doc_id long, level string, category string, line long, column long, detail string")


def summary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, P0, P1, P2, P3, status) for every document: ok without P0 and P1, error with P0, else warning."""
    counts = found.groupBy("doc_id").pivot("level", list(LEVELS)).agg(F.count(F.lit(1)))
    own = docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", *(F.coalesce(level, F.lit(0)).alias(level) for level in LEVELS))
    return own.withColumn("status", file_status(F.col("P0"), F.col("P1")))


def file_status(fatal: Column, severe: Column) -> Column:
    return F.when(fatal > 0, "error").when(severe > 0, "warning").otherwise("ok")
