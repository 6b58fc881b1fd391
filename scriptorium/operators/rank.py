"""Paragraph ranking by max-normalised TF-IDF and the cosine with a binary query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TOKEN = r"(?U)[\w\x{4e00}-\x{9fff}]{2,}"
#: A broadcast table of idf values has at most so many terms (about 60 bytes each); beyond that terms are joined by shuffle.
MOST_BROADCAST = 200_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def idf(paragraphs: DataFrame) -> DataFrame:
    """(term, idf): ln((N + 1) / (df + 1)) + 1 over (para_id, text), a row for each paragraph; counts combine on the map side."""
    terms = paragraphs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    total = paragraphs.agg(F.count_distinct("para_id").alias("total"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))  # one row
    return df.select("term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def with_terms(paragraphs: DataFrame) -> DataFrame:
    """A row for each different term of each of ``paragraphs`` (text, or its tokens as ``words``): the other columns, term and tf, its number over the largest of the paragraph's."""
    kept = [c for c in paragraphs.columns if c not in ("text", "words")]
    own = paragraphs if "words" in paragraphs.columns else paragraphs.withColumn("words", tokens(F.col("text")))
    # Each array is a generated column, so that the optimizer doesn't put its expression into the lambdas that read it.
    once = lambda df, name, value: df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
    own = once(own.select(*kept, "words"), "words", F.sort_array("words"))
    # Equal terms are neighbours; a term's number is the place of its last one less that of the term before.
    own = once(own, "last", F.filter(F.transform("words", lambda _, i: i + 1), lambda i: (i == F.size("words")) | (F.get("words", i) != F.get("words", i - 1))))
    own = once(own, "terms", F.transform("last", lambda i, k: F.struct(F.get("words", i - 1).alias("term"), (i - F.coalesce(F.get("last", k - 1), F.lit(0))).alias("n"))))
    own = own.select(*kept, F.array_max(F.transform("terms", lambda x: x["n"])).alias("most"), F.inline("terms"))
    return own.select(*kept, "term", (F.col("n") / F.col("most")).alias("tf"))


def scores(paragraphs: DataFrame, keywords: list[str], weights: DataFrame) -> DataFrame:
    """(para_id, score) of paragraphs that hold a keyword: the cosine of n / max n times idf with the set of keywords.

    A paragraph's terms are counted within its row, so that no task holds the terms of many paragraphs.
    """
    keys = sorted({k.lower() for k in keywords if len(k) > 1})
    own = paragraphs.select("para_id", "text").filter(F.lower("text").rlike("|".join(map(re.escape, keys)) or "(?!)"))
    weighted = with_terms(own).join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    hit = F.when(F.col("term").isin(*keys), F.col("w")).otherwise(0.0)
    return weighted.groupBy("para_id").agg((F.sum(hit) / (F.sqrt(F.sum(F.col("w") ** 2)) * F.sqrt(F.lit(float(len(keys)))))).alias("score"))


def rank(paragraphs: DataFrame, keywords: list[str], limit: int = 8, least: float = 0.01, fallback: int = 3) -> DataFrame:
    """(para_id, score): the ``limit`` best paragraphs by cosine above ``least``.

    Without a keyword of two letters the first ``limit`` paragraphs, and without a paragraph above ``least`` the first
    ``fallback``, in the order of para_id with score 0.
    """
    none = F.lit(0.0).alias("score")
    if not any(len(k) > 1 for k in keywords):
        return paragraphs.select("para_id", none).orderBy("para_id").limit(limit)
    # Kept between the count and the join, so that texts aren't counted twice; lost blocks are computed again.
    weights = idf(paragraphs).persist()
    if weights.count() <= MOST_BROADCAST:
        weights = F.broadcast(weights)
    best = scores(paragraphs, keywords, weights).filter(F.col("score") > least)
    best = best.select("para_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "para_id").limit(limit)
    first = paragraphs.select("para_id", none).orderBy("para_id").limit(fallback)
    ranked = best.withColumn("found", F.lit(True)).unionByName(first.withColumn("found", F.lit(False)))
    # At most limit + fallback rows.
    ranked = ranked.withColumn("any", F.max("found").over(Window.partitionBy()))
    return ranked.filter(F.col("found") == F.col("any")).select("para_id", "score").orderBy(F.desc("score"), "para_id")
