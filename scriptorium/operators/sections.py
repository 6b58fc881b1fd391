"""Documents as sections: split, chunked, transformed by a plug-in, put together and held against the original."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import enhance

# Bodies shorter than the first aren't transformed, longer than the second are cut.
LEAST_BODY, MOST_CHUNK = 50, 3000
Transform = Callable[[Column], Column]


def split(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, title, body): cut at ``## `` lines; part 0 stands before the first and has no title. An empty part 0 is left out."""
    parts = F.split(text, r"\n(?=## )", -1)
    # A text that begins with a chapter gets an empty preamble, so that chapters are numbered from 1.
    parts = F.when(F.col(text).startswith("## "), F.concat(F.array(F.lit(None).cast("string")), parts)).otherwise(parts)
    own = docs.select("doc_id", F.posexplode(parts).alias("part", "piece")).filter("piece IS NOT NULL")
    title = F.when(F.col("part") > 0, F.substring_index("piece", "\n", 1))
    body = F.when(F.col("part") == 0, F.col("piece")).otherwise(F.when(F.col("piece").contains("\n"), F.substr("piece", F.length(title) + 2)))
    return own.select("doc_id", "part", title.alias("title"), body.alias("body"))


def chunks(parts: DataFrame, most: int = MOST_CHUNK) -> DataFrame:
    """(doc_id, part, chunk, text): a body as it is, or, longer than ``most``, its pieces at ``### `` lines, in order. Joined by line ends they are the body."""
    pieces = F.when(F.length("body") > most, F.split("body", r"\n(?=### )", -1)).otherwise(F.array("body"))
    return parts.select("doc_id", "part", F.posexplode(pieces).alias("chunk", "text"))


def joined(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, text): chunks put together into bodies, and these, behind their titles, into documents. A group holds one document."""
    bodies = pieces.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    has = F.exists("rows", lambda r: r["text"].isNotNull())
    own = parts.select("doc_id", "part", "title").join(bodies, ["doc_id", "part"])
    text = F.when(F.col("title").isNull(), body).when(has, F.concat("title", F.lit("\n"), body)).otherwise(F.col("title"))
    whole = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", text.alias("text")))).alias("rows"))
    return whole.select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def enhanced(docs: DataFrame, transform: Transform, most: int = MOST_CHUNK) -> DataFrame:
    """(doc_id, text, changed): ``transform`` over each chunk of bodies that are long enough, cleaned, put together, guarded.

    Null from the transform leaves the chunk as it was. A document that loses a fence or a fourth-level heading is its
    original again; chapters that the original hasn't become bold lines.
    """
    parts = split(docs)
    made = F.when(F.length(F.trim("text")) >= LEAST_BODY, enhance.cleaned(transform(F.col("text"))))
    pieces = chunks(parts, most).withColumn("text", F.coalesce(made, F.col("text")))
    both = joined(parts, pieces).withColumnRenamed("text", "new").join(docs.select("doc_id", F.col("text").alias("old")), "doc_id")
    text = enhance.guarded(F.col("old"), enhance.demoted(F.col("new"), enhance.chapters(F.col("old"))))
    return both.select("doc_id", text.alias("text"), (text != F.col("old")).alias("changed"))
