"""Joins and windows over time: as-of joins, interval joins, sessions, late rows. Hot keys and hot times are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import scans
from scriptorium.tables import fresh, stored


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` with the same ``key`` whose ``time`` isn't after its own.

    Of several such rows of one time the last by ``tie`` counts. Rows of ``left`` without a key or a time, or with no row before them,
    have nulls. Both sides are one sorted sequence, in which the last row of ``right`` is carried on over ranges of (key, time):
    a key that holds most rows is split.
    """
    side, order, own, held, found = fresh(left, "side", "order", "own", "held", "found")
    of = [F.col(c).alias(c) for c in (key, time)]
    usable = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    packed = F.struct(*values)
    empty = usable.select(packed.alias("x")).schema["x"].dataType
    a = left.select(*of, F.lit(1).alias(side), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias(order), F.struct(*left.columns).alias(own), F.lit(None).cast(empty).alias(held))
    b = usable.select(*of, F.lit(0).alias(side), (F.col(tie) if tie else F.lit(None).cast("int")).alias(order), F.lit(None).cast(a.schema[own].dataType).alias(own), packed.alias(held))
    both = scans.carried(a.unionByName(b), key, [time, side, order], held, found)
    mine = both.filter(F.col(side) == 1)
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    return mine.select(f"{own}.*", *(F.when(known, F.col(found)[v]).alias(v) for v in values))


#: Points and intervals of one bin and key beyond which it is dealt over tasks, and over how many.
_HOT, _SALTS = 1024, 32


def interval_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, width: float, key: str | None = None) -> DataFrame:
    """Pairs of ``points`` and ``intervals`` (columns of both, whose names differ) with start <= time <= end, and equal ``key`` columns if given.

    ``time``, ``start`` and ``end`` are numbers. Each interval stands on the level whose bins, ``width`` times a power of 8, are as long
    as itself, so that it lies in two bins at most however long it is; each point is looked up once a level that there is. The
    exact condition is checked again. Bins with very many points are dealt by points. Nulls match nothing; empty intervals (end before start) neither.
    """
    level, bin_, salt = fresh(points.join(intervals, F.lit(False)), "level", "bin", "salt")
    spans = intervals.filter(F.col(start) <= F.col(end))
    length = F.greatest((F.col(end) - F.col(start)) / F.lit(float(width)), F.lit(1.0))
    spans = spans.withColumn(level, F.ceil(F.round(F.log(8.0, length), 9)).cast("int"))
    size = F.lit(float(width)) * F.pow(F.lit(8.0), F.col(level))
    of = lambda c: F.floor(F.col(c) / size).cast("long")
    # The distinct levels: some twenty for lengths of 18 orders of magnitude.
    levels = [r[0] for r in spans.select(level).distinct().collect()]
    spans = spans.withColumn(bin_, F.explode(F.sequence(of(start), of(end))))
    looked = points.filter(F.col(time).isNotNull()).withColumn(level, F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() AS array<int>)"))).withColumn(bin_, of(time))
    on = [level, bin_, *([key] if key else [])]
    looked = stored(looked, "points")
    hot = looked.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(_HOT, looked.count() // _HOT)).drop("n")
    # At most 1024 bins.
    marked = F.broadcast(hot.withColumn("hot", F.lit(True)))
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64(*points.columns), F.lit(_SALTS)).cast("int")).otherwise(0)
    looked = looked.join(marked, on, "left").withColumn(salt, dealt).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    spans = spans.join(marked, on, "left").withColumn(salt, F.explode(copies)).drop("hot")
    pairs = looked.join(spans, [*on, salt]).filter((F.col(start) <= F.col(time)) & (F.col(time) <= F.col(end)))
    return pairs.drop(level, bin_, salt)


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of a key's events less than ``gap`` apart; ``end`` is the last event. Map-side aggregation of Spark's session windows."""
    own = events.filter(F.col(time).isNotNull()).groupBy(key, F.session_window(time, gap).alias("session"))
    return own.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("session")


def sliding(events: DataFrame, key: str, time: str, length: str, step: str, *sums: Column) -> DataFrame:
    """(key, start, end, sums): windows of ``length`` that begin every ``step``; each event is in all that hold it."""
    own = events.groupBy(key, F.window(time, length, step).alias("w")).agg(*sums)
    return own.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *own.columns[2:])


def with_late(events: DataFrame, time: str, arrival: list[str], delay: str, name: str = "late") -> DataFrame:
    """``events`` with ``late``: whether an event's time lies more than ``delay`` (an interval) before the latest of all that arrived before it."""
    one, latest = fresh(events, "one", "latest")
    own = scans.carried(events.withColumn(one, F.lit(0)), one, arrival, time, latest, "max", inclusive=False)
    return own.withColumn(name, F.coalesce(F.col(time) < F.col(latest) - F.expr(f"INTERVAL {delay}"), F.lit(False))).drop(one, latest)
