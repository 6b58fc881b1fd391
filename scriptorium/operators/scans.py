"""Ordered scans over keyed rows, split by ranges so that a key that holds most rows isn't one task.

Rows are dealt and sorted by (key, order), so that a large key covers several neighbouring partitions, its segments. There are
three ways across the borders:

* ``running``: clamped sums. A row is a function ``x -> min(high, max(low, x + change))``; such functions compose to one of
  their own form, so every row gets the function of its segment so far, and the segments' functions, one a partition,
  give each segment's start.
* ``carried``: running aggregates, whose value for each key and range is carried on.
* ``replay``: any state machine. All segments run at once from the start state; then those that a different state
  reaches run again from it, until none changes. Most machines forget their start (a bucket runs full, a breaker
  closes), so few segments run twice; in the worst case there are as many rounds as a key has segments.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.tables import fresh, stored

Step = Callable[[Any, Any, Any], tuple[Any, tuple]]
#: Beyond any sum of 64-bit changes that a table can hold, and far from overflow.
FAR = 1 << 61


def ranges(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """``rows`` in partitions of neighbours by (key, order), sorted; as many as a shuffle has. Rows of equal order are split too."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (tie,) = fresh(rows, "tie")
    return rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, key, *order, tie).sortWithinPartitions(key, *order, tie).drop(tie)


def _chained(ends: list[tuple]) -> list[tuple[int, int]]:
    """(segment, the one before) of segments that go on with the key that the one before ends with. ``ends``: (segment, first key, last key), ordered."""
    return [(b[0], a[0]) for a, b in zip(ends, ends[1:]) if a[2] == b[1]]


# -- clamped sums ------------------------------------------------------------------------------


def running(rows: DataFrame, key: str, order: list[str | Column], change: str, name: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum, from 0, of ``change`` over the rows before within ``key`` by ``order``, clamped to ``low`` and ``high`` after each row.

    A null change is 0; a null key is a key; rows of equal order are taken one after the other in any order.
    """
    least, most = -FAR if low is None else low, FAR if high is None else high
    names = segment, place, first, add, floor, ceiling = fresh(rows, "segment", "place", "first", "add", "floor", "ceiling")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(names, [T.IntegerType(), T.LongType(), T.BooleanType(), *[T.LongType()] * 3], strict=True))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, seen, head, own = TaskContext.get().partitionId(), False, None, None
        total, lo, hi, done = 0, -FAR, FAR, 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, by in zip(batch.column(key).to_pylist(), batch.column(change).to_pylist(), strict=True):
                if not seen or k != own:
                    head, own, seen = head if seen else (k,), k, True
                    total, lo, hi = 0, -FAR, FAR
                for column, x in zip(out, ((k,) == head, total, lo, hi), strict=True):
                    column.append(x)
                by = by or 0
                total, lo, hi = total + by, min(most, max(least, lo + by)), min(most, max(least, hi + by))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([here] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), pa.array(out[0], pa.bool_()), *(pa.array(x, pa.int64()) for x in out[1:])], names=[*batch.schema.names, *names])
            done += n

    table = stored(ranges(rows, key, order).mapInArrow(scan, schema), "running")
    # A row a partition: its first and last key, and the function of its last key's rows but the last, whose change is beside it.
    whole = F.struct(F.col(key).alias("k"))
    edges = table.groupBy(segment).agg(F.min_by(whole, place).alias("head"), F.max_by(whole, place).alias("last"), F.max_by(F.struct(add, floor, ceiling, F.coalesce(F.col(change), F.lit(0)).cast("long")), place).alias("f"))
    ends = sorted(edges.collect(), key=lambda r: r[0])
    before = dict(_chained([(r[0], r["head"]["k"], r["last"]["k"]) for r in ends]))
    start, carry = {}, {}
    for r in ends:
        total, lo, hi, by = r["f"]
        total, lo, hi = total + by, min(most, max(least, lo + by)), min(most, max(least, hi + by))
        start[r[0]] = carry.get(before.get(r[0]), 0)
        own = start[r[0]] if r["head"] == r["last"] else 0
        carry[r[0]] = min(hi, max(lo, own + total))
    starts = table.sparkSession.createDataFrame([(s, x) for s, x in start.items() if x], "at_segment int, carried long")
    # A row a partition at most.
    found = table.join(F.broadcast(starts), F.col(segment) == F.col("at_segment"), "left")
    x = F.when(F.col(first), F.coalesce("carried", F.lit(0))).otherwise(0)
    value = F.least(F.col(ceiling), F.greatest(F.col(floor), x + F.col(add)))
    return found.withColumn(name, value.cast("long")).select(*[c for c in table.columns if c not in names], name)


# -- running aggregates ------------------------------------------------------------------------

#: How a running value is made, in a range and over the ranges before it, and how the two meet.
FOLDS = {
    "last": (lambda c: F.last(c, True), lambda before, own: F.coalesce(own, before)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "min": (F.min, lambda before, own: F.least(before, own)),
}


def carried(rows: DataFrame, key: str, order: list[str], value: str, name: str, fold: str = "last", inclusive: bool = True) -> DataFrame:
    """``rows`` with ``name``: the last non-null, the largest or the least ``value`` so far within ``key`` by ``order`` (columns, ascending, nulls first).

    Expressions only: windows run within ranges, and one row of each key and range carries on. Not ``inclusive``: of the rows
    before. A null key is a key; rows of equal order are taken one after the other.
    """
    make, meet = FOLDS[fold]
    segment, at, of, from_segment, before = fresh(rows, "segment", "at", "of", "from_segment", "before")
    table = stored(ranges(rows, key, order).withColumn(segment, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "carried")
    within = Window.partitionBy(segment, key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    total = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))) if fold == "last" else make(value)
    totals = table.groupBy(F.col(key).alias(of), F.col(segment).alias(from_segment)).agg(total.alias("total"))
    above = make("total").over(Window.partitionBy(of).orderBy(from_segment).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(of, from_segment, above.alias(before)).filter(F.col(before).isNotNull())
    found = table.withColumn(name, make(value).over(within))
    found = found.join(totals, F.col(key).eqNullSafe(F.col(of)) & (F.col(segment) == F.col(from_segment)), "left")
    return found.withColumn(name, meet(F.col(before), F.col(name))).select(*rows.columns, name)


# -- state machines ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """A start state, a step ``(state, time, value) -> (state, outputs)``, and the names and SQL types of its outputs. The start is never changed; a step may change a state that it has made."""

    start: Any
    step: Step
    outputs: tuple[tuple[str, str], ...]


def seconds(times: list) -> list[float]:
    """Seconds of numbers and times; a time without a zone is UTC."""
    return [(t if t.tzinfo else t.replace(tzinfo=dt.UTC)).timestamp() if hasattr(t, "timestamp") else float(t) for t in times]


def replay(rows: DataFrame, key: str, time: str, order: list[str | Column], value: str, machine: Machine) -> DataFrame:
    """``rows`` with the machine's outputs: each key's rows by ``order``, from the start state."""
    made = [n for n, _ in machine.outputs]
    segment, place, head, end, mark, carry, turn = fresh(rows, "segment", "place", "head", "end", "mark", "carry", "turn")
    kinds = [to_arrow_type(T.DataType.fromDDL(k)) for _, k in machine.outputs]
    extra = [T.StructField(segment, T.IntegerType()), T.StructField(place, T.LongType()), T.StructField(head, T.BooleanType()), T.StructField(end, T.BinaryType()), T.StructField(mark, T.StringType())]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DataType.fromDDL(k)) for n, k in machine.outputs), *extra])
    own_names = rows.columns

    def run(again: bool):
        """Runs sorted rows. The first time a partition is a segment; again, rows come by segments, each led by the row that carries its state."""

        def out(batch: pa.RecordBatch, outputs: list[list], at: list[int], numbers: list[int], heads: list[bool], ends: list) -> pa.RecordBatch:
            arrays = [*(batch.column(c) for c in own_names), *(pa.array(x, k) for x, k in zip(outputs, kinds, strict=True))]
            dumps = [None if e is None else pickle.dumps(e[0]) for e in ends]
            marks = [None if e is None else repr(e[0]) for e in ends]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(at, pa.int32()), pa.array(numbers, pa.int64()), pa.array(heads, pa.bool_()), pa.array(dumps, pa.binary()), pa.array(marks, pa.string())], names=schema.names)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = TaskContext.get().partitionId()
            state, seen, last, first, held, done = machine.start, False, None, None, None, 0
            for batch in batches:
                outputs: list[list] = [[] for _ in made]
                at, numbers, heads, ends, take = [], [], [], [], []
                carried = batch.column(carry).to_pylist() if again else [None] * batch.num_rows
                places = batch.column(segment).to_pylist() if again else [here] * batch.num_rows
                order_of = batch.column(place).to_pylist() if again else range(done, done + batch.num_rows)
                done += batch.num_rows
                times = seconds([t if c is None else 0.0 for c, t in zip(carried, batch.column(time).to_pylist(), strict=True)])
                for i, (k, now, v, c, where, number) in enumerate(zip(batch.column(key).to_pylist(), times, batch.column(value).to_pylist(), carried, places, order_of, strict=True)):
                    if c is not None:
                        if take:
                            ends[-1] = (state,)
                        elif held is not None:
                            held = (*held[:5], [(state,)])
                        state = pickle.loads(c)
                        continue
                    if not again and (not seen or k != last):
                        first, last, state, seen = first if seen else (k,), k, machine.start, True
                    state, produced = machine.step(state, now, v)
                    for column, x in zip(outputs, produced, strict=True):
                        column.append(x)
                    take.append(i)
                    at.append(where)
                    numbers.append(number)
                    heads.append(again or (k,) == first)
                    ends.append(None)
                if not take:
                    continue
                if held is not None:
                    yield out(*held)
                batch = batch.take(pa.array(take)) if len(take) < batch.num_rows else batch
                n = len(take) - 1
                if n:
                    yield out(batch.slice(0, n), [x[:n] for x in outputs], at[:n], numbers[:n], heads[:n], ends[:n])
                # The last row waits, as the state after a segment's last row goes with it.
                held = (batch.slice(n), [x[n:] for x in outputs], at[n:], numbers[n:], heads[n:], ends[n:])
            if held is not None:
                yield out(*held[:5], [(state,)])

        return scan

    tables = [stored(ranges(rows, key, order).mapInArrow(run(False), schema), "replay")]
    digest = F.sha2(F.col(mark), 256)
    whole = F.struct(F.col(key).alias("k"))
    edges = tables[0].groupBy(segment).agg(F.min_by(whole, place).alias("a"), F.max_by(whole, place).alias("b"), F.max(digest).alias("end"))
    # A row a partition: first and last key, and the digest of the last key's state.
    ends = sorted(((r[0], r["a"]["k"], r["b"]["k"], r["end"]) for r in edges.collect()), key=lambda r: r[0])
    chain = _chained(ends)
    single = {s for s, a, b, _ in ends if a == b}
    after = {s: e for s, _, _, e in ends}
    fed = dict.fromkeys(after, hashlib.sha256(repr(machine.start).encode()).hexdigest())
    version = dict.fromkeys(after, 0)  # of each segment's first key
    source = dict.fromkeys(after, 0)  # of each segment's end state
    spark = rows.sparkSession
    while wrong := [(s, p) for s, p in chain if after[p] != fed[s]]:
        turns = spark.createDataFrame([(s, p, source[p]) for s, p in wrong], "to_segment int, of_segment int, of_turn int")
        states = None
        for i, table in enumerate(tables):
            if any(source[p] == i for _, p in wrong):
                own = table.filter(F.col(end).isNotNull()).select(F.col(segment).alias("of_segment"), F.col(end).alias(carry)).withColumn("of_turn", F.lit(i))
                states = own if states is None else states.unionByName(own)
        states = states.join(F.broadcast(turns), ["of_segment", "of_turn"]).select(F.col("to_segment").alias(segment), carry)
        targets = F.broadcast(turns.select(F.col("to_segment").alias(segment)))
        first = tables[0].filter(head).join(targets, segment, "left_semi").select(*own_names, segment, place)
        led = first.withColumn(carry, F.lit(None).cast("binary")).unionByName(states, allowMissingColumns=True)
        led = led.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), segment).sortWithinPartitions(segment, F.col(carry).isNull(), place)
        again = stored(led.mapInArrow(run(True), schema), "replay")
        tables.append(again)
        new = dict(again.filter(F.col(end).isNotNull()).select(segment, digest).collect())
        for s, p in wrong:
            fed[s], version[s] = after[p], len(tables) - 1
        for s, _ in wrong:
            if s in single:
                after[s], source[s] = new[s], len(tables) - 1
    found = tables[0].withColumn(turn, F.lit(0))
    for i, table in enumerate(tables[1:], 1):
        found = found.unionByName(table.withColumn(turn, F.lit(i)))
    if len(tables) > 1:
        latest = F.broadcast(spark.createDataFrame([(s, v) for s, v in version.items()], "is_segment int, is_turn int"))
        found = found.join(latest, F.col(segment) == F.col("is_segment")).filter(~F.col(head) | (F.col(turn) == F.col("is_turn")))
    return found.select(*own_names, *made)
