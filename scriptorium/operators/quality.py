"""Scores of Markdown documents in their dimensions, and the gate's verdict, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.tables import fresh

# The default profile.
WEIGHTS = {"completeness": 0.18, "structure": 0.12, "readability": 0.10, "citation": 0.12, "depth": 0.10, "substance": 0.18}
THRESHOLD = 70.0


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n", -1), lambda p: F.length(F.trim(p)) > 30)


def completeness(text: Column, parts: Parts | None = None) -> Column:
    few = F.greatest(F.lit(0), 3 - F.size((parts or Parts.of(text)).paragraphs))
    lost = F.when(text.rlike(r"(?m)^#\s"), 0).otherwise(25) + F.when(text.contains("## 目录") | F.left(text, F.lit(500)).contains("目录"), 0).otherwise(15)
    return F.greatest(F.lit(0), 100 - lost - F.when(text.rlike("(?m)^## 参考"), 0).otherwise(20) - 20 * few)


def levels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#+)\s"), 1), F.length)


def structure(text: Column, parts: Parts | None = None) -> Column:
    at = (parts or Parts.of(text)).levels
    n1, n2 = F.size(F.filter(at, lambda x: x == 1)), F.size(F.filter(at, lambda x: x == 2))
    steps = F.zip_with(F.slice(at, F.lit(2), F.size(at)), at, lambda after, before: F.when(after - before > 1, 1).otherwise(0))
    jumps = F.aggregate(steps, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    lost = F.when(n1 == 0, 20).when(n1 > 1, 10).otherwise(0) + 5 * jumps + F.when(n2 < 2, 15 * (2 - n2)).otherwise(0)
    return F.when(F.size(at) == 0, 30).otherwise(F.greatest(F.lit(0), 100 - lost))


def readability(text: Column, parts: Parts | None = None) -> Column:
    long_lines = F.size(F.filter(F.split(text, "\n", -1), lambda x: F.length(x) > 120))
    plain = F.when(text.contains("```") | text.contains("> "), 0).otherwise(10) + F.when(text.contains("- ") | text.contains("* "), 0).otherwise(5)
    return F.greatest(F.lit(0), 100 - 2 * long_lines - plain)


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]*)\)"), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)[\w\x{4e00}-\x{9fff}]{2,}"), 0)


@dataclass(frozen=True)
class Parts:
    """What several dimensions read of a text."""

    paragraphs: Column
    levels: Column
    links: Column
    tokens: Column
    lowered: Column
    head: Column
    sets: Column
    likeness: Column

    @classmethod
    def of(cls, text: Column, bind: Callable[[str, Column], Column] = lambda _, column: column) -> Parts:
        """``head``: the first 30 lines, lower-cased; ``sets``: each paragraph's tokens; ``likeness``: of the two neighbouring paragraphs most alike.

        ``bind`` names a part before others build on it.
        """
        own: dict[str, Column] = {}
        for name, make in (
            ("paragraphs", lambda: paragraphs(text)),
            ("levels", lambda: levels(text)),
            ("links", lambda: links(text)),
            ("tokens", lambda: tokens(text)),
            ("lowered", lambda: F.lower(text)),
            ("head", lambda: F.array_join(F.slice(F.split(own["lowered"], "\n", -1), 1, 30), "\n")),
            ("sets", lambda: F.transform(own["paragraphs"], lambda p: F.array_distinct(tokens(p)))),
            ("likeness", lambda: likeness(own["sets"])),
        ):
            own[name] = bind(name, make())
        return cls(**own)


def likeness(sets: Column) -> Column:
    """The largest Jaccard similarity of neighbouring sets; 0 without two."""
    alike = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    return F.coalesce(F.array_max(F.zip_with(sets, F.slice(sets, F.lit(2), F.size(sets)), lambda a, b: F.coalesce(alike(a, b), F.lit(0.0)))), F.lit(0.0))


def citation(text: Column, parts: Parts | None = None) -> Column:
    cost = lambda u: F.when(F.trim(u) == "", 15).when(u.startswith("https://example.com"), 10).when(~(u.startswith("http") | u.startswith("#")), 5).otherwise(0)
    found = (parts or Parts.of(text)).links
    return F.when(F.size(found) == 0, 50).otherwise(F.greatest(F.lit(0), 100 - F.aggregate(found, F.lit(0), lambda a, u: a + cost(u))))


def depth(text: Column, parts: Parts | None = None) -> Column:
    n = F.length(text)
    score = F.when(n < 200, 30).when(n < 500, 50).when(n < 1000, 70).when(n > 5000, 95).otherwise(100)
    return F.when(F.size((parts or Parts.of(text)).paragraphs) < 3, F.least(score, F.lit(40))).otherwise(score)


def with_parts(docs: DataFrame, text: str) -> tuple[DataFrame, Parts, list[str]]:
    """``docs`` with a column for each of the parts, so that a text is cut once however many dimensions read it; the parts, and the columns' names."""
    names = dict(zip((f.name for f in fields(Parts)), fresh(docs, *(f.name for f in fields(Parts))), strict=True))

    def bind(name: str, column: Column) -> Column:
        nonlocal docs
        docs = docs.withColumn(names[name], column)
        return F.col(names[name])

    parts = Parts.of(F.col(text), bind)
    return docs, parts, list(names.values())


def with_overall(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with overall: the weighted mean of the first five dimensions, to one place."""
    dimensions = {"completeness": completeness, "structure": structure, "readability": readability, "citation": citation, "depth": depth}
    own, parts, names = with_parts(docs, text)
    total = sum(WEIGHTS[k] for k in dimensions)
    mean = reduce(Column.__add__, (f(F.col(text), parts) * WEIGHTS[k] for k, f in dimensions.items()), F.lit(0.0)) / total
    return own.withColumn("overall", F.round(mean, 1)).drop(*names)


# Words without content of their own.
HOLLOW_WORDS = ("的 了 是 在 和 与 及 也 都 就 而 等 我们 可以 这个 那个 一种 以及 通过 对于 由于 因此 但是 因为 the a an of to and or in on for is are be").split()
TOPIC_STOP_WORDS = ("的 了 是 在 我 有 和 与 及 一个 这份 介绍 简单 基本 概念 生成 一份 文档 技术 测试 这是 用于 验证 流水线 是否 正常 工作 a the of to and is for this that with in on").split()
# Fixed values: (name, pattern, penalty) of the default style rules; a rule costs its penalty once.
STYLE_RULES = (("deep_heading", r"^#{4,}\s", 5), ("empty_heading", r"^#+\s*$", 10), ("empty_link", r"\[([^\]]*)\]\(\s*\)", 15), ("blank_lines", r"\n{4,}", 3))
MAX_PENALTY, CITATION_PENALTY = 40, 5


def substance(text: Column, parts: Parts | None = None) -> Column:
    """Share of content words, likeness of neighbouring paragraphs, and whether a digit, code or list occurs."""
    parts = parts or Parts.of(text)
    paras, words = parts.paragraphs, parts.tokens
    density = F.size(F.filter(words, lambda w: ~F.lower(w).isin(*HOLLOW_WORDS))) / F.greatest(F.size(words), F.lit(1))
    most = parts.likeness
    lost = F.when((F.size(words) > 0) & (density < 0.4), 25 * (0.4 - density) / 0.4).otherwise(0.0) + F.when(most > 0.6, 30 * (most - 0.6) / 0.4).otherwise(0.0)
    bare = ~(text.rlike(r"\p{Nd}") | text.contains("```") | text.rlike(r"(?m)^\s*[-*]\s"))
    return F.when(F.size(paras) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - lost - F.when(bare, 20).otherwise(0)))


def topic_tokens(queries: list[str]) -> tuple[list[str], list[str]]:
    """(tokens, proper names) of a few queries: Latin words, short Chinese runs, and the 2-grams of longer ones."""
    import re

    found, names = [], []
    for q in queries:
        names += [w.lower() for w in re.findall(r"\b[A-Z][a-zA-Z]{2,}\b", q)]
        found += re.findall(r"[a-z]{2,}", q.lower())
        for run in re.findall(r"[一-鿿]{2,}", q):
            found += [run] if len(run) <= 3 else [run[i : i + 2] for i in range(len(run) - 1)]
    keep = lambda words: sorted(set(words) - set(TOPIC_STOP_WORDS))
    return keep(found + names), keep(names)


def topic_relevance(text: Column, queries: list[str], parts: Parts | None = None) -> Column:
    """70 parts for tokens anywhere, 30 for those in the first 30 lines; 0 if a proper name is missing; 70 without tokens."""
    every, names = topic_tokens(queries)
    if not every:
        return F.lit(70.0)
    parts = parts or Parts.of(text)
    low, head = parts.lowered, parts.head
    share = lambda where: sum((where.contains(t).cast("int") for t in every), F.lit(0)) / F.lit(float(len(every)))
    score = F.round(F.least(F.lit(100.0), share(low) * 70 + share(head) * 30), 1)
    for name in names:
        score = F.when(~low.contains(name), 0.0).otherwise(score)
    return score


def style_penalty(text: Column) -> Column:
    return sum((F.when(text.rlike(pattern), cost).otherwise(0) for _, pattern, cost in STYLE_RULES), F.lit(0))


def citation_issues(text: Column) -> Column:
    """Of the links with a target: those that are neither a web address, an anchor nor rooted, and those without a title."""
    pairs = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\([^)]+\)"), 0)
    strange = F.filter(pairs, lambda x: ~F.regexp_extract(x, r"\]\(([^)]*)\)", 1).rlike("^(https?://|#|/)"))
    return F.size(strange) + F.size(F.filter(pairs, lambda x: F.trim(F.regexp_extract(x, r"\[([^\]]*)\]", 1)) == ""))


def citation_counts(text: Column) -> list[Column]:
    """total_refs, unique_urls, duplicates (targets that occur more than once) and issues; links without a target count, but raise no issue."""
    urls = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]*)\)"), 1)
    once = F.array_distinct(urls)
    twice = F.size(F.filter(once, lambda u: F.size(F.filter(urls, lambda v: v == u)) > 1))
    return [x.cast("long").alias(n) for x, n in ((F.size(urls), "total_refs"), (F.size(once), "unique_urls"), (twice, "duplicates"), (citation_issues(text), "issues"))]


@dataclass(frozen=True)
class Profile:
    """What a quality profile says: weights of dimensions, style rules (name, pattern, penalty), threshold and limits."""

    weights: dict[str, float] = field(default_factory=lambda: WEIGHTS | {"topic_relevance": 0.20, "style": 0.10})
    rules: tuple[tuple[str, str, float], ...] = STYLE_RULES
    threshold: float = THRESHOLD
    most_penalty: float = MAX_PENALTY
    citations: bool = True
    citation_penalty: float = CITATION_PENALTY
    most_generations: int = 3

    @classmethod
    def of(cls, profile: Mapping[str, Any], **over: Any) -> Profile:
        """From a profile as YAML gives it (weights, style_rules, threshold, max_penalty, check_citations, max_regenerations), ``over`` laid on top."""
        own = {**profile, **over}
        rules = own.get("style_rules")
        default = cls()
        return cls(
            weights=dict(own.get("weights") or default.weights),
            rules=default.rules if rules is None else tuple((r["name"], r["pattern"], r.get("penalty", 0)) for r in rules if r.get("enabled", True)),
            threshold=float(own.get("threshold", default.threshold)),
            most_penalty=float(own.get("max_penalty", default.most_penalty)),
            citations=bool(own.get("check_citations", True)),
            citation_penalty=float(own.get("citation_penalty", default.citation_penalty)),
            most_generations=int(own.get("max_regenerations", default.most_generations)),
        )

    def dimensions(self, text: Column, queries: list[str], parts: Parts | None = None) -> dict[str, Column]:
        every = {"completeness": completeness, "structure": structure, "readability": readability, "citation": citation, "depth": depth, "substance": substance}
        return {name: f(text, parts).cast("double") for name, f in every.items()} | {"topic_relevance": topic_relevance(text, queries, parts).cast("double")}

    def penalty(self, text: Column) -> Column:
        style = reduce(lambda a, rule: a + F.when(text.rlike(rule[1]), float(rule[2])).otherwise(0.0), self.rules, F.lit(0.0))
        issues = self.citation_penalty * citation_issues(text) if self.citations else F.lit(0.0)
        return F.least(style + issues, F.lit(self.most_penalty))

    def overall(self, scores: Mapping[str, Column], penalty: Column) -> Column:
        """Weighted mean, a weight without dimension counting as 0 (the plain mean without a weight above 0), less the penalty, to one place."""
        total = sum(w for w in self.weights.values() if w > 0)
        if total > 0:
            mean = reduce(Column.__add__, (scores[n] * w for n, w in self.weights.items() if n in scores), F.lit(0.0)) / total
        else:
            mean = reduce(Column.__add__, scores.values(), F.lit(0.0)) / len(scores)
        return F.round(F.greatest(F.lit(0.0), mean - penalty), 1)

    def verdict(self, docs: DataFrame, text: str, queries: list[str], generation: Column) -> DataFrame:
        """``docs`` with all dimensions, penalty, overall, needs_regenerate (below the threshold) and can_regenerate (and generations are left).

        Parts, dimensions and overall are columns one after the other: each is computed once.
        """
        own, parts, names = with_parts(docs, text)
        scores = self.dimensions(F.col(text), queries, parts)
        own = own.withColumns(scores | {"penalty": self.penalty(F.col(text))})
        own = own.withColumn("overall", self.overall({n: F.col(n) for n in scores}, F.col("penalty")))
        below = F.col("overall") < self.threshold
        return own.withColumns({"needs_regenerate": below, "can_regenerate": below & (generation < self.most_generations)}).drop(*names)
