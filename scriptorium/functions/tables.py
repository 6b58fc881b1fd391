"""Table functions for SQL: ``SELECT ... FROM docs, LATERAL lint_text(text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scriptorium.operators import ascii_art, layout, lint


@udtf(returnType="level string, category string, line long, column long, detail string")
class LintText:
    """Findings of a text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from lint.findings(text)


@udtf(returnType="sec_no long, title string, line_start long, digest string")
class SectionTable:
    """Sections of a text; a null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        if text is not None:
            yield from layout.cut_sections(text.split("\n"))


@udtf(returnType="kind string, start long, stop long, confidence double, fragment boolean")
class TextDrawings:
    """Drawings of a text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for d in ascii_art.drawings(text):
            yield d.kind, d.start, d.stop, float(d.confidence), d.fragment


TABLE_FUNCTIONS = {"lint_text": LintText, "section_table": SectionTable, "text_drawings": TextDrawings}


def register(spark: SparkSession) -> None:
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
