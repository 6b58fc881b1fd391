import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium import __main__ as cli
from scriptorium.operators import scans, versions
from scriptorium.plans import planner, runner
from scriptorium.sources import engines, files, tables, writes
from scriptorium.streaming import bus, control

START = dt.datetime(2024, 1, 1)

# -- sources and sinks -------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# no\n  apache kafka \ntest this\nabc\n", "utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\n#\n")
    got = sorted((r.path.rsplit("/", 1)[1], r.pos, r.query) for r in files.queries(spark, str(tmp_path), "default one").collect())
    assert got == [("a.txt", 1, "apache kafka"), ("b.txt", None, "default one")]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "x.jsonl").write_text('{"ts": 1, "level": "error"}\nbroken\n{"ts": 3, "level": "info"}\n{"ts": 2, "level": "error"}\n')
    assert [r.ts for r in files.log_rows(spark, str(logs), "ts long, level string", 1, level="error").collect()] == [2]
    (tmp_path / "p.yaml").write_text("threshold: 75\nweights: {a: 1}\n")
    assert files.find_profile("p", [tmp_path], {"threshold": 70, "max": 1}) == {"threshold": 75, "max": 1, "weights": {"a": 1}} and files.find_profile("q", [], {"x": 1}) == {"x": 1}
    (tmp_path / ".env").write_text("# c\nA=1\nB='x'\nC=yes\n")
    (tmp_path / "deep").mkdir()
    assert files.settings(tmp_path / "deep", environment={"B": "over", "C": ""}) == {"A": 1, "B": "over", "C": True}


def test_keyed_table(spark, tmp_path):
    row = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    t = tables.KeyedTable(spark, str(tmp_path / "t"), row((1, "")).schema, ["id"])
    assert t.rows().collect() == []
    t.insert(row((1, "a"), (2, "b")))
    t.insert(row((1, "later")))
    t.upsert(row((2, "c")))
    t.upsert(row((2, "d"), (3, "e")))
    assert sorted(map(tuple, t.rows().collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert [tuple(r) for r in t.lookup(id=2).collect()] == [(2, "d")]
    assert t.compact(str(tmp_path / "u")).rows().count() == 3


def test_table_cache(spark, tmp_path):
    now, made = [100.0], []

    def make():
        made.append(1)
        return spark.range(len(made))

    cache = tables.TableCache(spark, str(tmp_path), ttl=10, clock=lambda: now[0])
    assert cache.get("k", make).count() == 1 and cache.get("k", make).count() == 1
    now[0] = 110.5
    assert cache.get("k", make).count() == 2 and cache.hit_rate == 1 / 3


def test_safe_writer(tmp_path):
    now = [1000.0]
    w = writes.SafeWriter(tmp_path, clock=lambda: now[0], newest=2)
    assert w.write("a.md", " ")["level"] == "P0" and not (tmp_path / "a.md").exists()
    assert w.write("a.md", "x" * 100)["version"] == 1
    assert w.write("a.md", "x" * 49)["level"] == "P1" and w.write("a.md", "x" * 501)["level"] == "P1"
    for i in range(4):
        now[0] += 1
        out = w.write("a.md", f"{i}" * 100)
    assert out["version"] == 5 and out["diff"] and len(list((tmp_path / ".backups").iterdir())) == 2
    now[0] += 8 * 86400
    w.write("a.md", "z" * 100)
    assert len(list((tmp_path / ".backups").iterdir())) == 1
    script = writes.SafeWriter(tmp_path, ratios=versions.SCRIPT_RATIOS, lines=0.7, newline="crlf", dry_run=True)
    assert script.level("a\n" * 6, "a\n" * 10) == "P1" and script.level("a\n" * 8, "a\n" * 10) == "ok" and not script.write("b.md", "x")["written"]
    writes.SafeWriter(tmp_path, newline="crlf").write("c.csv", "a\nb")
    assert (tmp_path / "c.csv").read_bytes() == b"\xef\xbb\xbfa\r\nb"


def test_state_comes_back_from_its_copy(tmp_path):
    path = tmp_path / "s.json"
    assert writes.load_state(path) is None
    writes.save_state(path, {"a": 1})
    writes.save_state(path, {"a": 2})
    assert writes.load_state(path) == {"a": 2}
    path.write_text(path.read_text().replace('"a": 2', '"a": 3'))
    assert writes.load_state(path) == {"a": 1}


def test_articles_logs_and_hooks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A b", "http://a", "text"), (1, "", "http://b", "other")], "task long, title string, url string, text string")
    writes.write_articles(rows, str(tmp_path / "articles"))
    got = spark.read.parquet(str(tmp_path / "articles")).collect()
    assert {r.task for r in got} == {1} and "A_b" in {r.file for r in got} and any(r.content == "# A b\n\n> http://a\n\ntext" for r in got)
    logs = spark.createDataFrame([(START, "task.done"), (START + dt.timedelta(days=1), "run.end")], "ts timestamp, event string")
    logs.coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(logs.schema).json(str(tmp_path / "in"))
    for _ in range(2):
        writes.write_log(stream(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and (tmp_path / "log" / "day=2024-01-02").is_dir()

    def sender(folder):
        def send(rows):
            (folder / f"{uuid.uuid4().hex}.txt").write_text("\n".join(r["event"] for r in rows))

        folder.mkdir()
        return send

    writes.call_hooks(stream(), {"task.*": sender(tmp_path / "some"), "*": sender(tmp_path / "all")}, "event", str(tmp_path / "cp2")).awaitTermination()
    sent = lambda name: sorted(x for f in (tmp_path / name).iterdir() for x in f.read_text().split("\n"))
    assert sent("some") == ["task.done"] and sent("all") == ["run.end", "task.done"]


def test_engines(spark):
    engines.register("mine", lambda q, n: [{"title": q.upper(), "url": "http://x", "score": 1}] * 3)
    got = engines.search(spark, ["a", "b"], ["mine", "unknown"], 2).orderBy("query", "engine", "pos").collect()
    # The mock engine has one row for a query.
    assert len(got) == 6 and got[0].title == "A" and {r.score for r in got if r.engine == "unknown"} == {0.5}
    answers = {"ok": (200, "page"), "gone": (404, ""), "busy": (429, "")}
    pages = engines.fetched(spark.createDataFrame([(u,) for u in answers], "url string"), lambda u, _: answers[u], ("x", "y"))
    assert {r.url: (r.status, r.attempts, r.html) for r in pages.collect()} == {"ok": (200, 1, "page"), "gone": (404, 1, None), "busy": (429, 3, None)}


# -- streams -----------------------------------------------------------------------------------


def events(spark, seconds, ok):
    rows = [(i, "k", START + dt.timedelta(seconds=s), good) for i, (s, good) in enumerate(zip(seconds, ok, strict=True))]
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, ok boolean")


@pytest.mark.parametrize("machine", [control.bucket(0.5, 2), control.breaker(2, 60), control.provider(2, 60)])
def test_streams_keep_their_state_over_restarts(spark, tmp_path, machine):
    whole = events(spark, [0, 1, 2, 3, 70, 71, 140, 141], [False, False, True, True, False, True, True, False])
    want = scans.replay(whole, "key", "ts", ["ts", "id"], "ok", machine)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in ("id < 3", "id >= 3"):
        whole.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = control.stream_control(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in")), "key", "ts", ["ts", "id"], "ok", machine)
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_provider_and_cache(spark):
    calls = events(spark, [0, 1, 2, 70, 71], [False, False, True, True, True])
    got = control.provider_calls(calls, "key", "ts", ["ts", "id"], "ok", 2, 60).orderBy("id").collect()
    assert [(r.admitted, r.healthy) for r in got] == [(True, True), (True, False), (False, False), (True, True), (True, True)]
    step, state, hits = control.lru(2, 10).step, (), []
    for now, key in ((0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, "a"), (20, "a")):
        state, (hit,) = step(state, now, key)
        hits.append(hit)
    assert hits == [False, False, True, False, False, False, False] and control.lru(2, -1).step((), 0, "a") == ((), (False,))


def test_bus(spark, tmp_path):
    rows = [("1", "a", "x"), ("1", "a", "x"), ("2", "a", "bad"), ("3", "b", "y"), ("4", "c", "z")]
    messages = spark.createDataFrame(rows, "msg_id string, topic string, payload string")
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []

    def handler(name, fails="payload = 'bad'"):
        def run(batch):
            seen.append((name, batch.count()))
            return batch.filter(fails)

        return run

    def broken(batch):
        raise RuntimeError("down")

    own = bus.Bus(spark, str(tmp_path / "bus"))
    own.subscribe("a", "late", handler("late"), 5)
    own.subscribe("a", "first", handler("first"), 1)
    own.subscribe("b", "broken", broken)
    for _ in range(2):
        own.start(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))).awaitTermination()
    assert seen == [("first", 2), ("late", 2)] and own.delivered().count() == 4
    assert sorted((r.msg_id, r.subscriber) for r in own.letters().collect()) == [("2", "first"), ("2", "late"), ("3", "broken")]
    again = bus.Bus(spark, str(tmp_path / "bus"))
    again.subscribe("a", "late", handler("late"))
    again.subscribe("b", "broken", handler("broken", "false"))
    left = lambda df: sorted((r.msg_id, r.subscriber, r.replay_count) for r in df.collect())
    # The letter of "first" has no subscriber any more; that of "broken" succeeds and is settled.
    assert left(again.replay()) == [("2", "first", 0), ("2", "late", 1)]
    assert left(again.replay()) == left(own.letters()) == [("2", "first", 0), ("2", "late", 2)]
    assert left(again.replay(most=2)) == [("2", "first", 0), ("2", "late", 2)]
    third = bus.Bus(spark, str(tmp_path / "bus"))
    third.subscribe("a", "late", handler("late", "false"))
    third.subscribe("a", "first", broken)
    seen.clear()
    assert left(third.replay()) == [("2", "first", 1)] and seen == [("late", 1)]


# -- plans -------------------------------------------------------------------------------------

SPEC = """
pipeline: {name: p, fail_fast: false, retry: {attempts: 2, base: 0.1}, defaults: {priority: 5}}
nodes:
  - {name: search, agent: source, pool_size: 2}
  - {name: fetch, dependencies: [search], priority: 1}
  - {name: audit, dependencies: [search], retry: {attempts: 1}}
  - {name: write, dependencies: [fetch]}
"""


def test_planner():
    plan = planner.build(files.parse_yaml(SPEC), {"write": {"timeout": 7}})
    assert plan.levels == [["search_pool_0", "search_pool_1"], ["fetch", "audit"], ["write"]]
    assert plan.step("write").settings["timeout"] == 7 and plan.step("audit").settings["retry"] == {"attempts": 1, "strategy": "exponential", "base": 0.1}
    assert planner.ordered(plan) == ["search_pool_0", "search_pool_1", "fetch", "audit", "write"]
    assert "Level 1:\n  fetch <- search_pool_0, search_pool_1 (pool 1, timeout 120 s, 2 attempts)" in planner.preview(plan)
    assert [s.name for s in planner.narrowed(plan, ["audit"]).steps] == ["search_pool_0", "search_pool_1", "audit"]
    assert planner.dependency_mismatches(plan, {"fetch": ["search"], "write": ["audit"]}) == ["write"]
    with pytest.raises(ValueError, match="stands on level"):
        planner.build({"nodes": [{"name": "a", "level": 1, "dependencies": ["b"]}, {"name": "b", "level": 1}]})
    with pytest.raises(ValueError, match="cycle"):
        planner.build({"nodes": [{"name": "a", "dependencies": ["b"]}, {"name": "b", "dependencies": ["a"]}]})
    assert planner.check_settings({"n": True, "s": 1, "ok": 2}, {"n": "int", "s": "str", "ok": "int"}) == ["n", "s"]
    assert planner.unsafe_calls("import os\nos.system('x')\nprint(1)\neval('2')") == ["eval", "os.system"] and planner.unsafe_calls("def") == ["syntax"]
    assert planner.executor_for("render_html") == "process" and planner.executor_for("fetch") == "thread"


class Source:
    def run(self, spark, inputs, settings):
        return runner.of_shard(spark.range(6).withColumnRenamed("id", "n"), "n", settings)


class Double:
    tries, started = 0, 0

    def on_start(self):
        type(self).started += 1

    def run(self, spark, inputs, settings):
        type(self).tries += 1
        if self.tries == 1:
            raise RuntimeError("first")
        return runner.merged_pool(inputs, "search").select((F.col("n") * 2).alias("n"))


class Broken:
    def run(self, spark, inputs, settings):
        raise RuntimeError("always")


def registry():
    out = runner.Registry()
    for name, stage in (("source", Source), ("fetch", Double), ("audit", Broken), ("write", Copy)):
        out.register(name, stage)
    return out


class Copy:
    def run(self, spark, inputs, settings):
        return inputs["fetch"]


def test_runner(spark, tmp_path):
    Double.tries = Double.started = 0
    plan, told = planner.build(files.parse_yaml(SPEC)), []
    run = runner.Run(spark, plan, registry(), str(tmp_path), {"stage.*": lambda e, p: told.append((e, p["stage"]))}, sleep=lambda s: None)
    assert run.execute() == {"search_pool_0": "ok", "search_pool_1": "ok", "fetch": "ok", "audit": "failed", "write": "ok"}
    assert sorted(r.n for r in run.results["write"].collect()) == [0, 2, 4, 6, 8, 10] and Double.started == 2
    assert ("stage.failed", "audit") in told and ("stage.done", "write") in told and run.audit_table().filter("event = 'level.done'").count() == 3
    more = runner.Run(spark, plan, registry(), str(tmp_path), sleep=lambda s: None)
    assert more.execute()["write"] == "saved" and more.rollback("fetch") == ["fetch", "write"]
    assert runner.Run(spark, plan, registry(), str(tmp_path), sleep=lambda s: None).execute()["write"] == "ok"
    fast = runner.Run(spark, planner.Plan("p", plan.steps, True), registry(), sleep=lambda s: None)
    assert "write" not in fast.execute() and fast.report()["events"]["stage.failed"] == 1
    stopped = runner.Run(spark, plan, registry())
    stopped.pause()
    stopped.cancel()
    assert runner.submit_many([stopped, runner.Run(spark, planner.narrowed(plan, ["search_pool_0"]), registry())]) == ["Cancelled: p", {"search_pool_0": "ok"}]
    one, two = spark.range(1), spark.range(2)
    assert runner.resolve_content({"writer": one, "layout": two}) is two and runner.resolve_content({"writer": one}) is one and runner.resolve_content({}) is None
    assert runner.delay("linear", 2, 3) == 6 and runner.delay("exponential", 1, 20) == 120


def test_command_line(tmp_path, capsys):
    (tmp_path / "p.yaml").write_text(SPEC)
    assert cli.main(["plan", str(tmp_path / "p.yaml")]) == 0 and "Plan p: 5 nodes" in capsys.readouterr().out
    (tmp_path / "d.md").write_text("# A\n")
    assert cli.main(["check", str(tmp_path / "d.md")]) == 1 and json.loads(capsys.readouterr().out)["status"] == "warning"
    assert cli.main(["queries"]) == 0 and "page_extract_rank" in capsys.readouterr().out
    assert cli.main(["query", "none", "x"]) == 2 and cli.main(["state", str(tmp_path)]) == 0
