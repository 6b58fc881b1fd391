"""Texts from a language model: cleaning, and guards that hold a rewrite against its original. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines in which a model announces its own output.
META_LINES = ("增强后的 Markdown 内容", "增强后的内容", "优化后的内容", "增强后内容", "以下是增强后的内容", "以下是优化后的内容")
_CHAPTER = r"^## .*\S"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_thoughts(text: Column) -> Column:
    """Without ``<think>`` spans, trimmed."""
    return stripped(F.regexp_replace(text, r"(?s)<\s*think\s*>.*?<\s*/\s*think\s*>", ""))


def escaped(text: Column) -> Column:
    """Brackets, parentheses, ``*`` and ``_`` behind a backslash."""
    return F.regexp_replace(text, r"([\[\]()*_])", r"\\$1")


def cleaned(text: Column) -> Column:
    """Without chapter headings (they are set anew around the body) and lines that announce the output."""
    body = F.filter(F.split(text, "\n", -1), lambda line: ~(stripped(line).rlike(_CHAPTER) | stripped(line).isin(*META_LINES)))
    return F.array_join(body, "\n")


def guarded(original: Column, rewritten: Column) -> Column:
    """The rewrite, unless the number of fences differs or a heading of level 4 is lost: then the original."""
    fences = lambda x: F.regexp_count(x, F.lit("\n```"))
    titles = lambda x: F.regexp_extract_all(x, F.lit("(?md)^#### .+"), F.lit(0))
    lost = F.size(F.array_except(titles(original), titles(rewritten))) > 0
    return F.when((fences(original) != fences(rewritten)) | lost, original).otherwise(rewritten)


def chapters(text: Column) -> Column:
    """The stripped chapter headings of a text."""
    return F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda line: line.rlike(_CHAPTER))


def demoted(text: Column, known: Column) -> Column:
    """Chapter headings that aren't among ``known`` become bold lines."""

    def line(x: Column) -> Column:
        bare = stripped(x)
        return F.when(bare.rlike(_CHAPTER) & ~F.array_contains(known, bare), F.concat(F.lit("**"), F.substr(bare, F.lit(4)), F.lit("**"))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def mermaid_blocks(text: Column) -> Column:
    """The code of whole Mermaid blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```mermaid\n(.*?)```"), 1)


def with_image_links(text: Column, folder: str) -> Column:
    """Whole Mermaid blocks replaced by links to pictures named by the digest of their code, as a renderer would write them."""
    fence = r"(?s)```mermaid\n(.*?)\n```"
    codes = F.regexp_extract_all(text, F.lit(fence), 1)
    name = lambda code: F.concat(F.lit("mermaid_"), F.left(F.sha2(code, 256), F.lit(12)), F.lit(".png"))
    link = lambda code: F.concat(F.lit("!["), name(code), F.lit(f"]({folder}/"), name(code), F.lit(")"))
    between = F.split(text, fence, -1)
    rest = F.zip_with(codes, F.slice(between, F.lit(2), F.size(codes)), lambda code, after: F.concat(link(code), after))
    return F.concat(F.get(between, 0), F.array_join(rest, ""))


def filled_prompt(prompt: Column, **values: Column) -> Column:
    """A prompt's text with ``{name}`` replaced by the values given; other braces stay."""
    for name, value in values.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return prompt
