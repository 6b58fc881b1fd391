"""Sketches of values by day that merge over days: quantiles (KLL) and distinct counts (HyperLogLog). Days are aggregated once; any span of days merges small rows.

A quantile's rank is off by at most 1.7 % of all values (k = 200, in 99 of 100 cases), a distinct count by 3 times 1.04 / sqrt(2^12) = 4.9 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, LOG2_REGISTERS = 200, 12
RANK_ERROR, COUNT_ERROR = 0.017, 0.049


def daily(events: DataFrame, by: list[str], value: str, who: str) -> DataFrame:
    """(by, n, values, people): the count and both sketches of each group; null values and people aren't counted in them."""
    quantiles = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K))
    people = F.hll_sketch_agg(F.col(who).cast("string"), F.lit(LOG2_REGISTERS))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), quantiles.alias("values"), people.alias("people"))


def merged(days: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """(by, n, q..., people): over all rows of ``daily`` of a group, its count, quantiles (q50 for 0.5) and distinct people."""
    own = days.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("people").alias("people"))
    found = [F.kll_sketch_get_quantile_double("values", F.lit(q)).alias(f"q{q * 100:g}") for q in quantiles]
    return own.select(*by, "n", *found, F.hll_sketch_estimate("people").alias("people"))
