"""Graphs of links between pages: edges from their HTML, and ranks by message passing until they settle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.tables import stored

#: Links of a page in one row at most, on average.
PIECE = 1024


def links(pages: DataFrame) -> DataFrame:
    """(source, target): each page (url, html) and what it links to, once, without queries and fragments. Relative links start at the host."""
    bare = lambda c: F.regexp_extract(c, "^[^?#]*", 0)
    own = pages.select(bare(F.col("url")).alias("source"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), 1))).alias("to"))
    target = F.when(F.col("to").startswith("/"), F.concat("host", bare(F.col("to")))).when(F.col("to").rlike("^https?://"), bare(F.col("to")))
    return own.select("source", target.alias("target")).filter("target IS NOT NULL AND source <> target").distinct()


def ranks(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 60) -> DataFrame:
    """(node, rank): shares of a walk over ``edges`` (source, target; distinct) that follows a link with probability ``damping`` and else starts anywhere.

    Nodes without links pass their rank to all. A round joins ranks with rows of at most about 1,024 links, so that a hub's links are dealt over
    tasks, and sums by target with map-side combining. Its joins are merges: a broadcast would send a table to the driver each round. It ends when all ranks together change by less than ``tolerance``, or after ``most`` rounds. Ranks sum to 1; an empty table has none.
    """
    nodes = stored(edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct(), "nodes")
    n = nodes.count()
    degrees = edges.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    piece = F.pmod(F.xxhash64("target"), F.ceil(F.col("degree") / PIECE))
    held = edges.join(degrees, "source").groupBy("source", "degree", piece.alias("piece")).agg(F.collect_list("target").alias("targets"))
    held = stored(held.withColumnRenamed("source", "node"), "pieces")
    current = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(most):
        sent = current.join(held.hint("shuffle_merge"), "node").select(F.explode("targets").alias("node"), (F.col("rank") / F.col("degree")).alias("part"))
        got = stored(sent.groupBy("node").agg(F.sum("part").alias("got")), "messages")
        # What no link passes on.
        loose = 1.0 - (got.agg(F.sum("got")).first()[0] or 0.0)
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n) if n else F.lit(0.0)
        after = stored(current.join(got.hint("shuffle_merge"), "node", "left").select("node", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change")), "ranks")
        change = after.agg(F.sum("change")).first()[0] or 0.0
        current = after.select("node", "rank")
        if change < tolerance:
            break
    return current
