"""Rewriting until the score passes: each round works only on the documents that still fail."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regenerate(docs: DataFrame, score: Callable[[Column], Column], rewrite: Callable[[DataFrame], DataFrame], threshold: float, most: int = 2) -> DataFrame:
    """``docs`` with text, score, generation and status: ``pass`` or ``accepted_with_warnings``.

    A null score fails. ``rewrite`` keeps rows and columns and changes text. With a checkpoint
    folder each round is a table there; without one the plan just grows by a round.
    """
    scored = lambda frame, n: frame.withColumn("score", score(F.col("text"))).withColumn("generation", F.lit(n))
    cut = (lambda frame: frame.checkpoint()) if docs.sparkSession.sparkContext.getCheckpointDir() else (lambda frame: frame)
    passes = F.coalesce(F.col("score") >= threshold, F.lit(False))
    open_, done = cut(scored(docs, 0)), []
    for n in range(1, most + 1):
        done.append(open_.filter(passes))
        open_ = cut(scored(rewrite(open_.filter(~passes).select(*docs.columns)), n))
    both = reduce(DataFrame.unionByName, [*done, open_])
    return both.withColumn("status", F.when(passes, "pass").otherwise("accepted_with_warnings"))
