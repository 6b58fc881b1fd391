import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import monitor, scans
from scriptorium.streaming import control

SCHEMA = "id long, k string, t double, v long, segment string, place int"


def made(n, keys, seed):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rng.choice((0.0, 0.0, 0.3, 0.7, 5.0))
        rows.append((i, rng.choice(keys), t, rng.choice((1, 1, 1, -1, None)), "x", 1))
    return rows


#: One key alone, a key beside others and without one, and a table with nothing.
TABLES = [made(600, ["a"], 1), made(500, ["a", "a", "a", "a", "b", None, "c"], 2), []]


def by_key(rows, run):
    """{id: result of ``run`` over the rows of its key in order}."""
    out = {}
    for k in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        out.update(zip((r[0] for r in own), run(own), strict=True))
    return out


@pytest.mark.parametrize("low,high", [(None, None), (0, None), (0, 5), (-2, 2)])
@pytest.mark.parametrize("rows", TABLES)
def test_running_equals_the_loop(spark, rows, low, high):
    def loop(own):
        x, out = 0, []
        for r in own:
            out.append(x)
            x += r[3] or 0
            x = x if low is None else max(low, x)
            x = x if high is None else min(high, x)
        return out

    got = scans.running(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", ["t", "id"], "v", "before", low, high)
    assert got.columns == ["id", "k", "t", "v", "segment", "place", "before"]
    assert {r.id: r.before for r in got.collect()} == by_key(rows, loop)


def machines():
    return {
        "bucket": control.bucket(2.0, 3.0),
        "waiting": control.waiting_bucket(2.0, 3, 1.0),
        "never_idle": control.waiting_bucket(0.01, 1, 1e9),
        "breaker": control.breaker(2, 2.0, 2),
        "provider": control.provider(2, 3.0),
        "lru": control.lru(3, 4.0),
        "keys": control.known_keys(4),
    }


@pytest.mark.parametrize("name", machines())
@pytest.mark.parametrize("rows", TABLES)
def test_replay_equals_the_loop(spark, rows, name):
    machine = machines()[name]
    rows = [(*r[:3], (r[0] * r[0]) % 7, *r[4:]) for r in rows]
    value = (lambda v: v > 2) if name in ("breaker", "provider") else (lambda v: v)

    def loop(own):
        state, out = machine.start, []
        for r in own:
            state, made = machine.step(state, r[2], value(r[3]))
            out.append(tuple(made))
        return out

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumn("v", F.col("v") > 2) if name in ("breaker", "provider") else df
    got = scans.replay(df, "k", "t", ["t", "id"], "v", machine).collect()
    made_names = [n for n, _ in machine.outputs]
    assert len(got) == len(rows)
    assert {r.id: tuple(r[n] for n in made_names) for r in got} == by_key(rows, loop)


def test_one_key_is_split(spark):
    rows = spark.createDataFrame(TABLES[0] * 1, SCHEMA)
    sizes = [r[1] for r in scans.ranges(rows, "k", ["t", "id"]).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 5 * median(sizes)


def test_depth_never_passes_the_limit(spark):
    log = spark.createDataFrame([(i, "q", c) for i, c in enumerate([1] * 6 + [-1, 1, 1, -1, -1, -1, -1, -1, 1])], "id long, q string, c int")
    out = monitor.queue_depth(log, "q", "c", ["id"], 3).orderBy("id").collect()
    assert [r.depth for r in out] == [1, 2, 3, 3, 3, 3, 2, 3, 3, 2, 1, 0, 0, 0, 1]
    assert [r.id for r in out if r.busy] == [3, 4, 5, 8]


def test_waiting_requests_queue_up(spark):
    rows = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0.0, 0.0, 0.0, 0.0, 0.5, 9.0])], "id long, k string, t double")
    out = control.waiting_tokens(rows, "k", "t", ["t", "id"], 1.0, 2, 1.5).orderBy("id").collect()
    assert [(r.granted, r.waited_us) for r in out] == [(True, 0), (True, 0), (True, 1_000_000), (False, None), (True, 1_500_000), (True, 0)]


def test_every_row_has_a_version(spark):
    from scriptorium.operators import versions

    rows = [("f", 1, 1), ("f", 1, 2), ("f", None, 3), (None, 2, 4), ("f", None, 5), ("f", 0, 6), ("g", None, 7)]
    df = spark.createDataFrame(rows, "file string, at int, place int")
    got = versions.numbered(df, "file", "at").collect()
    assert sorted((str(r.file), r.number) for r in got) == sorted([("f", i) for i in range(1, 6)] + [("None", 1), ("g", 1)])
    assert [r.place for r in sorted(got, key=lambda r: (str(r.file), r.number)) if r.file == "f" and r.at is not None][0] == 6
    assert {r.number for r in got if r.file == "f" and r.at is None} == {4, 5}
    before = versions.with_previous(df, "file", "at", "place").collect()
    assert len(before) == len(rows) and before[0].asDict().keys() == {"file", "at", "place", "previous"}
    assert sum(r.previous is None for r in before) == 3
    assert versions.numbered(df.limit(0), "file", "at").collect() == []


def test_a_column_named_like_a_helper_stays(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, v int, place int")
    assert [tuple(r) for r in monitor.newest(df, ["k"], [F.desc("v")], 1).collect()] == [("a", 2, 6)]


def test_totals_and_calls_without_a_provider(spark):
    calls = spark.createDataFrame([(1, None, 0.5), (1, "x", 0.25), (None, "x", 1.0)], "task int, provider string, cost double")
    got = {(r.task, r.provider, r.total): r.cost for r in monitor.cost_of_task(calls, "task").collect()}
    assert got == {(1, None, False): 0.5, (1, "x", False): 0.25, (1, None, True): 0.75, (None, "x", False): 1.0, (None, None, True): 1.0}


def test_frames_escape_line_breaks(spark):
    df = spark.createDataFrame([(7, "chunk", 'a\n"b"', 12)], "id long, kind string, data string, ts long")
    frame = df.select(monitor.sse_frame(F.col("id"), F.col("kind"), F.col("data"), F.col("ts"))).first()[0]
    assert frame == 'id: 7\ndata: {"type":"chunk","data":"a\\n\\"b\\"","ts":12,"section":-1,"total":0}\n\n'


def test_costs_add_up_in_any_order_and_round_as_the_sql_does(spark):
    rng = random.Random(5)
    rows = [(t, "x", rng.random() * 10 ** rng.randint(-6, 2)) for t in range(60) for _ in range(t + 1)]
    ties = [math.nextafter((2 * k + 1) / 2e6, 0) for k in range(60, 4000, 7)]
    rows += [(100 + i, "x", v) for i, v in enumerate(ties)]
    away = lambda x: (math.floor(x * 1e6) + (x * 1e6 % 1 >= 0.5)) / 1e6
    want = {t: away(math.fsum(v for u, _, v in rows if u == t)) for t in {t for t, _, _ in rows}}
    for seed in (1, 2):
        rng.shuffle(rows)
        calls = spark.createDataFrame(rows, "task int, provider string, cost double").repartition(seed)
        got = {(r.task, r.total): r.cost for r in monitor.cost_of_task(calls, "task").collect()}
        assert got == {(t, total): v for t, v in want.items() for total in (True, False)}
    odd = spark.createDataFrame([(1, float("inf")), (2, None), (3, 1e300), (3, -1e300), (4, None), (4, -0.5)], "g int, v double")
    got = dict(odd.groupBy("g").agg(monitor.exact_sum(F.col("v"))).collect())
    assert got == {1: float("inf"), 2: None, 3: 0.0, 4: -0.5}
