"""Sections of generated documents, versions and names of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections and the words that speak for them.
SECTIONS = {
    "技术教程": ("教程", "指南", "入门", "安装", "配置", "使用"),
    "概念原理": ("概念", "原理", "机制", "架构", "设计", "模式"),
    "实践应用": ("实践", "应用", "案例", "示例", "场景", "项目"),
    "对比分析": ("对比", "区别", "比较", "优缺点", "vs", "versus"),
    "最佳实践": ("最佳实践", "建议", "技巧", "推荐", "优化"),
}
OTHER = "其他"


def section_of(text: Column) -> Column:
    """The section with the most words in the text, the first of equals; ``OTHER`` if none occurs."""
    low = F.lower(text)
    hits = {name: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for name, words in SECTIONS.items()}
    best = F.greatest(*hits.values())
    choice = F.when(best == 0, OTHER)
    for name, n in hits.items():
        choice = choice.when(n == best, name)
    return choice


def safe_name(title: Column, url: Column, most: int = 60) -> Column:
    """The title with anything but letters, digits, ``_`` and ``-`` replaced; a digest of the URL without a title."""
    clean = F.substring(F.regexp_replace(title, r"[^a-zA-Z0-9_\x{4e00}-\x{9fff}-]", "_"), 1, most)
    return F.when(title == "", F.left(F.sha2(url, 256), F.lit(12))).otherwise(clean)


# The plan of a document without a model, and the words that a section looks for.
PLAN = (
    ("概述", ("概述", "简介", "概念", "背景")), ("核心架构", ("架构", "设计", "原理", "组件")), ("关键特性", ("特性", "功能", "特点", "支持")),
    ("工作流程", ("流程", "工作", "数据流", "处理")), ("实践应用", ("实践", "应用", "部署", "配置", "使用")), ("总结", ("总结", "最佳实践", "建议", "展望")),
)


def paragraph_score(text: Column, words: tuple[str, ...], topic: list[str]) -> Column:
    """A point for each word and two for each topic word that occurs, by thousand characters of longer texts."""
    low = F.lower(text)
    points = sum(((2 if w in topic else 1) * low.contains(w.lower()).cast("int") for w in (*words, *topic)), F.lit(0))
    return points / F.greatest(F.length(text) / 1000, F.lit(1.0))


def section_paragraphs(paragraphs: DataFrame, order: list[str], topic: list[str], most: int = 3) -> DataFrame:
    """(section, *order, score, text): the best paragraphs of each section of ``PLAN``, equal beginnings once; ties by ``order``.

    All scores come from one pass; the limit within a section runs before the shuffle.
    """
    scored = F.explode(F.array(*(F.struct(F.lit(i).alias("section"), paragraph_score(F.col("text"), words, topic).alias("score")) for i, (_, words) in enumerate(PLAN))))
    own = paragraphs.select(*order, "text", scored.alias("_s")).select(*order, "text", "_s.*").filter("score > 0")
    best = Window.partitionBy("section").orderBy(F.col("score").desc(), *order)
    own = own.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)
    alike = Window.partitionBy("section", F.substring("text", 1, 200)).orderBy("_n")
    return own.withColumn("_m", F.row_number().over(alike)).filter("_m = 1").select("section", *order, "score", "text")


STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "的", "是", "在", "和", "了", "有", "与", "及", "等")


def keywords(docs: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """(key, word, n): the ``most`` frequent words of more than two letters for each key, after punctuation became blanks."""
    blank = r"\s\x0B\x1C-\x1F\x85\p{Z}"
    plain = F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{blank}]", " "))
    words = docs.select(key, F.explode(F.split(plain, f"[{blank}]+")).alias("word")).filter((F.length("word") > 2) & ~F.col("word").isin(*STOP_WORDS))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    return counts.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most).drop("at")
