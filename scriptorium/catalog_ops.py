"""Queries of the monitoring, version, message and stream operators. Their SQL is written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import _CALLS, _NAMES, PRICES, _md, shared_sql
from scriptorium.operators import monitor, scans, versions
from scriptorium.operators.monitor import count_if
from scriptorium.registry import register
from scriptorium.streaming import control
from scriptorium.tables import load

_CALLS_SQL = _CALLS.format(conversations="conversations")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each conversation: characters as tokens, providers by number."""
    assistant = F.col("role") == "assistant"
    own = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.sum(F.when(c, 0).otherwise(F.length("text"))).cast("long").alias(n) for n, c in (("prompt", assistant), ("completion", ~assistant))))
    own = own.withColumn("provider", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("conv_id") % 13 + 1).cast("int")))
    return monitor.with_cost(own, PRICES, (0.001, 0.002))


# -- costs -------------------------------------------------------------------------------------

_SUMS = "count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens, CAST(sum(prompt + completion) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS cost"


@register(shared_sql("cost_by_provider"))
def cost_by_provider(spark, sf_dir):
    return monitor.cost_by(_calls(spark, sf_dir), ["provider"])


@register(_CALLS_SQL + f"SELECT provider, {_SUMS} FROM costs WHERE conv_id >= 12 GROUP BY provider")
def cost_since(spark, sf_dir):
    """Costs by provider from the twelfth conversation on (its number stands for the time)."""
    return monitor.cost_by(_calls(spark, sf_dir), ["provider"], F.lit(12), "conv_id")


@register(_CALLS_SQL + "SELECT conv_id % 40 AS task_id, provider, false AS total, round(sum(cost), 6) AS cost FROM costs GROUP BY 1, 2 UNION ALL SELECT conv_id % 40, NULL, true, round(sum(cost), 6) FROM costs GROUP BY 1")
def cost_by_task(spark, sf_dir):
    return monitor.cost_of_task(_calls(spark, sf_dir).withColumn("task_id", F.col("conv_id") % 40), "task_id")


@register(shared_sql("cost_summary"))
def cost_summary(spark, sf_dir):
    return monitor.budget(_calls(spark, sf_dir), 10.0)


@register("SELECT event_id FROM events, (SELECT max(ts) AS latest FROM events) AS m WHERE ts >= m.latest - INTERVAL '7' DAY")
def cost_cleanup(spark, sf_dir):
    return monitor.kept_since(_events(spark, sf_dir).select("event_id", "ts"), "ts", 7).select("event_id")


#: Each text as it is, and with its vowels as Chinese characters.
_ESTIMATE = r"CASE WHEN length({t}) = 0 THEN 0 ELSE ({c}) // 2 + (length({t}) - ({c})) // 4 + 1 END::BIGINT"
_CJK_OF = r"length({t}) - length(regexp_replace({t}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g'))"


@register("SELECT doc_id, " + ", ".join(f"{_ESTIMATE.format(t=t, c=_CJK_OF.format(t=t))} AS {n}" for n, t in (("tokens", "t"), ("mixed", "m"))) + " FROM (SELECT doc_id, text AS t, translate(text, 'aeiou', '你好世界们') AS m FROM documents)")
def token_estimate(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", monitor.token_estimate(F.col("text")).alias("tokens"), monitor.token_estimate(F.translate("text", "aeiou", "你好世界们")).alias("mixed"))


# -- quality feedback --------------------------------------------------------------------------

_PATTERNS = "SELECT lang AS dimension, count(*) AS n, round(avg(CAST(n_chars % 101 AS DOUBLE)), 1) AS avg_score, round(avg((n_chars % 101 < 70)::INT), 2) AS weak_rate, avg((n_chars % 101 < 70)::INT) > 0.4 AS problematic FROM documents GROUP BY lang HAVING count(*) >= 3"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") % 101).alias("score"))


@register(_PATTERNS)
def weak_patterns(spark, sf_dir):
    return monitor.weak_patterns(_scores(spark, sf_dir), "lang", "score")


@register(f"SELECT dimension, weak_rate, 'improve ' || dimension || ': weak in ' || CAST(round(weak_rate * 100) AS BIGINT) || '% of ' || n || ' samples' AS advice FROM ({_PATTERNS}) WHERE problematic ORDER BY weak_rate DESC, dimension LIMIT 3")
def recommendations(spark, sf_dir):
    """The three weakest languages (a top-k report)."""
    return monitor.recommendations(monitor.weak_patterns(_scores(spark, sf_dir), "lang", "score"))


@register(shared_sql("quality_totals"))
def quality_totals(spark, sf_dir):
    return _scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("tasks"), F.round(F.avg(F.col("score").cast("double")), 4).alias("avg_score"))


# -- queues and tasks --------------------------------------------------------------------------

_STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'cancelled' END"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("status", F.expr(_STATE))


@register("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def queue_stats(spark, sf_dir):
    return monitor.by_status(_events(spark, sf_dir), "event_type")


@register(f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER (s = {x!r}) AS {x}' for x in monitor.STATES)}, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (s = 'done') / count(*), 4) END AS success_rate FROM (SELECT {_STATE} AS s FROM events)")
def batch_summary(spark, sf_dir):
    return monitor.batch_summary(_tasks(spark, sf_dir), "status")


@register(f"SELECT user_id, CASE s WHEN 'running' THEN 'pending' ELSE s END AS status FROM (SELECT user_id, {_STATE} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) AS r WHERE n = 1")
def queue_recover(spark, sf_dir):
    return monitor.latest_state(_tasks(spark, sf_dir), "user_id", "status", ["ts", "event_id"], recover=True)


@register(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {_STATE} = 'pending') AS r WHERE n = 1")
def queue_fifo(spark, sf_dir):
    return monitor.acquired(_tasks(spark, sf_dir).filter("status = 'pending'"), "user_id", ["ts", "event_id"], "event_id")


@register(f"SELECT event_id, coalesce((b = 'pending' AND s IN ('running', 'cancelled')) OR (b = 'running' AND s IN ('done', 'failed', 'cancelled', 'pending')), s = 'pending') AS allowed FROM (SELECT event_id, {_STATE} AS s, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)")
def task_transitions(spark, sf_dir):
    """Whether each change of a task's state is one that the machine has; a task starts as pending."""
    before = F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = _tasks(spark, sf_dir).withColumn("before", before)
    return own.select("event_id", F.coalesce(monitor.transition_ok(F.col("before"), F.col("status")), F.col("status") == "pending").alias("allowed"))


@register(f"SELECT event_id FROM (SELECT event_id, {_STATE} IN ('done', 'failed', 'cancelled') AS over, row_number() OVER (PARTITION BY user_id, {_STATE} IN ('done', 'failed', 'cancelled') ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE NOT over OR n <= 5")
def task_history_trim(spark, sf_dir):
    """Open tasks and the five that finished last of each user."""
    finished = F.col("status").isin("done", "failed", "cancelled")
    return monitor.trimmed_history(_tasks(spark, sf_dir), finished, [F.desc("ts"), F.desc("event_id")], ["user_id"], 5).select("event_id")


@register("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10, event_id) AS place FROM events")
def batch_priority(spark, sf_dir):
    """The place of each event in its user's queue, by priority (the last digit of its number), then number. A user with very many events is split."""
    queued = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 10).alias("priority"), F.lit(1).alias("one"))
    return scans.running(queued, "user_id", ["priority", "event_id"], "one", "before").select("user_id", "event_id", (F.col("before") + 1).alias("place"))


@register("SELECT user_id, CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (event_type = 'purchase') / count(*) * 100) ELSE 0 END::BIGINT AS percent FROM events GROUP BY user_id")
def task_progress(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(monitor.progress(count_if("event_type = 'purchase'"), F.count(F.lit(1))).alias("percent"))


@register("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 AS shard FROM conversations")
def pool_shard(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("one"))
    return scans.running(turns, "conv_id", ["turn"], "one", "before").select("conv_id", "turn", (F.col("before") % 3).alias("shard"))


_RESULTS = "conv_id % 30 AS task, (CASE conv_id % 2 WHEN 0 THEN 'researcher' ELSE 'fetcher' END) || '_pool_' || (turn % 3) AS node, conv_id * 100 + turn AS at, CASE WHEN turn % 3 = 1 THEN {empty} ELSE {rows} END AS rows, turn AS query_count, {engines} AS engines"


@register(f"""WITH r AS (SELECT {_RESULTS.replace(" AS at,", " AS ix,").format(empty='[]::VARCHAR[]', rows="['r' || conv_id, 's' || turn]", engines="[role, 'e' || (turn % 2)]")} FROM conversations), b AS (SELECT *, split_part(node, '_pool_', 1) AS base FROM r),
e AS (SELECT task, base, string_agg(DISTINCT x, ',' ORDER BY x) AS used FROM (SELECT task, base, unnest(engines) AS x FROM b) GROUP BY ALL)
SELECT task, base, CASE WHEN base = 'researcher' THEN sum(len(rows))::BIGINT END AS total, CASE WHEN base = 'researcher' THEN sum(query_count)::BIGINT END AS query_count, CASE WHEN base = 'researcher' THEN any_value(used) END AS engines_used,
 CASE WHEN base <> 'researcher' THEN arg_min(array_to_string(rows, ','), ix) FILTER (len(rows) > 0) END AS first_result FROM b JOIN e USING (task, base) GROUP BY task, base""")
def pool_merge(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").selectExpr(*(x.strip() for x in _split(_RESULTS.format(empty="cast(array() AS array<string>)", rows="array('r' || conv_id, 's' || turn)", engines="array(role, 'e' || (turn % 2))"))))
    return monitor.pool_merge(rows, "node", ["researcher"])


def _split(columns: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth = [""], 0
    for c in columns:
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@register("""WITH e AS (SELECT * FROM (VALUES ('fetch', 'research', 0), ('write', 'fetch', 0), ('write', 'research', 1), ('gate', 'write', 0)) t(node, dependency, n)), r AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'research_pool_' || turn WHEN 1 THEN 'fetch' ELSE 'write' END AS node, conv_id::VARCHAR || '.' || turn AS value FROM conversations)
SELECT e.node, n AS "at", r.node AS "of", value FROM e JOIN r ON split_part(r.node, '_pool_', 1) = dependency""")
def dep_collect(spark, sf_dir):
    """Turns of all conversations as results, and as inputs of four nodes."""
    edges = spark.createDataFrame([("fetch", "research", 0), ("write", "fetch", 0), ("write", "research", 1), ("gate", "write", 0)], "node string, dependency string, at int")
    results = load(spark, sf_dir, "conversations").selectExpr("CASE conv_id % 3 WHEN 0 THEN 'research_pool_' || turn WHEN 1 THEN 'fetch' ELSE 'write' END AS node", "conv_id || '.' || turn AS value")
    return monitor.dependency_inputs(edges, results)


# -- messages ----------------------------------------------------------------------------------


@register("SELECT event_id, user_id, props FROM (SELECT event_id, user_id, props, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS n FROM events) AS r WHERE n = 1")
def idempotent_dedup(spark, sf_dir):
    keyed = _events(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "props"))
    return control.first_of_key(keyed, "key", ["ts", "event_id"]).select("event_id", "user_id", "props")


_KIND = "CASE event_type WHEN 'click' THEN 'sent' WHEN 'view' THEN 'received' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retried' ELSE 'dlq' END"


@register(f"SELECT user_id % 5 AS topic, {', '.join(f'count(*) FILTER (k = {x!r}) AS {x}' for x in ('sent', 'received', 'failed', 'retried', 'dlq'))} FROM (SELECT *, {_KIND} AS k FROM events) GROUP BY 1")
def message_metrics(spark, sf_dir):
    return monitor.message_metrics(_events(spark, sf_dir).select((F.col("user_id") % 5).alias("of"), F.expr(_KIND).alias("kind")), "of", "kind")


_CHANGE = "CASE WHEN event_type IN ('click', 'view', 'error') THEN 1 ELSE -1 END"
#: A publish at five is refused, a delivery from an empty queue finds nothing.
_DEPTHS = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, {_CHANGE} AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 d AS (SELECT *, greatest(0, c)::BIGINT AS depth, false AS busy FROM e WHERE n = 1
 UNION ALL SELECT e.*, least(5, greatest(0, d.depth + e.c))::BIGINT, e.c > 0 AND d.depth >= 5 FROM d JOIN e ON e.user_id = d.user_id AND e.n = d.n + 1)"""


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.expr(_CHANGE).alias("change"))
    return monitor.queue_depth(log, "user_id", "change", ["ts", "event_id"], 5)


@register(f"{_DEPTHS} SELECT event_id, depth, busy FROM d")
def backpressure_depth(spark, sf_dir):
    """The depth of each user's queue after each event, and publishes that are refused as they find it at five."""
    return _depths(spark, sf_dir).select("event_id", "depth", "busy")


@register(f"{_DEPTHS} SELECT user_id AS queue, max(depth) AS peak_depth, count(*) FILTER (busy) AS watermark_hits, arg_max(depth, {{'a': ts, 'b': event_id}}) AS undelivered FROM d GROUP BY user_id")
def bus_health(spark, sf_dir):
    return monitor.depth_summary(_depths(spark, sf_dir).withColumn("at", F.struct("ts", "event_id")), "user_id")


_LETTERS = "SELECT key, ts, event_id, n - 1 AS replay_count FROM (SELECT user_id || ':' || props AS key, ts, event_id, count(*) OVER (PARTITION BY user_id, props) AS n, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r = 1"


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _events(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "props"))
    return monitor.dead_letters(keyed, "key", F.col("event_type") == "error", ["ts", "event_id"])


@register(f"SELECT key, event_id, replay_count::BIGINT AS replay_count FROM ({_LETTERS})")
def dlq_split(spark, sf_dir):
    return _letters(spark, sf_dir).select("key", "event_id", "replay_count")


@register(f"SELECT key, event_id, (replay_count + 1)::BIGINT AS replay_count FROM ({_LETTERS}) WHERE replay_count < 1")
def dlq_replay(spark, sf_dir):
    """Letters that failed once are published again."""
    return monitor.replayed(_letters(spark, sf_dir), 1).select("key", "event_id", "replay_count")


@register("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 7)::BIGINT AS batch FROM events")
def bus_drain(spark, sf_dir):
    """Micro-batches of seven for each user."""
    return monitor.drained(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 7).select("event_id", "batch")


@register("""SELECT correlation, asked, answered, answered - asked AS waited FROM (SELECT conv_id * 1000 + turn // 2 AS correlation, min(turn) FILTER (role = 'user') AS asked, min(turn) FILTER (role = 'assistant') AS answered FROM conversations GROUP BY 1) WHERE asked IS NOT NULL""")
def request_response(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("correlation"), "turn", F.when(F.col("role") == "user", "request").when(F.col("role") == "assistant", "response").alias("kind"))
    return monitor.answered(turns, "correlation", "kind", "turn")


_SUBSCRIBERS = (("error", "pager", 1), ("error", "log", 5), ("error", "audit", 5), ("purchase", "log", 2), ("purchase", "ledger", 1))


@register(f"WITH s AS (SELECT * FROM (VALUES {', '.join(map(str, _SUBSCRIBERS))}) t(topic, subscriber, priority)) SELECT event_id, subscriber, row_number() OVER (PARTITION BY event_id ORDER BY priority, subscriber) AS place FROM events JOIN s ON event_type = topic")
def topic_subscribers(spark, sf_dir):
    subscribers = spark.createDataFrame(list(_SUBSCRIBERS), "topic string, subscriber string, priority int")
    return monitor.subscribers_of(_events(spark, sf_dir).withColumnRenamed("event_type", "topic"), subscribers).select("event_id", "subscriber", "place")


_HOOKS = ("*", "events.error", "events.*", "event.*", "sign*")


@register(f"SELECT event_id, pattern FROM events JOIN (SELECT * FROM (VALUES {', '.join(f'({p!r})' for p in _HOOKS)}) t(pattern)) ON pattern = '*' OR pattern = 'events.' || event_type OR (ends_with(pattern, '.*') AND starts_with('events.' || event_type, left(pattern, length(pattern) - 1)))")
def hook_match(spark, sf_dir):
    """Events against five patterns (a small, broadcast table)."""
    hooks = spark.createDataFrame([(p,) for p in _HOOKS], "pattern string")
    named = _events(spark, sf_dir).select("event_id", F.concat(F.lit("events."), "event_type").alias("name"))
    return named.join(F.broadcast(hooks), monitor.hook_matches(F.col("name"), F.col("pattern"))).select("event_id", "pattern")


@register("SELECT count(*) AS messages, count(*) FILTER (event_type = 'error') AS dlq, count(DISTINCT user_id) AS processed_keys, CASE WHEN count(*) FILTER (event_type = 'error') > 0.1 * count(*) THEN 'degraded' ELSE 'ok' END AS status FROM events")
def store_health(spark, sf_dir):
    events = _events(spark, sf_dir)
    return monitor.health(events, events.filter("event_type = 'error'"), events.select("user_id").distinct())


# -- streams -----------------------------------------------------------------------------------


@register("SELECT event_type AS kind, count(*) AS n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS events_per_sec, round((epoch(max(ts)) - epoch(min(ts))) / count(*), 3) AS avg_latency FROM events GROUP BY event_type")
def stream_metrics(spark, sf_dir):
    return monitor.stream_metrics(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts")


@register("""WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), c AS (SELECT user_id, client, CASE client WHEN 'late' THEN max(event_id) // 2 END AS last_id FROM events, (VALUES ('late'), ('new')) t(client) GROUP BY user_id, client)
SELECT client, k.user_id, event_id FROM c JOIN k USING (user_id) WHERE n <= 20 AND (last_id IS NULL OR event_id > last_id)""")
def sse_resume(spark, sf_dir):
    """Two clients of each user's stream: one that resumes, one that is new, with a history of twenty."""
    events = _events(spark, sf_dir).select("user_id", "event_id")
    ends = events.groupBy("user_id").agg(F.floor(F.max("event_id") / 2).alias("half"))
    clients = ends.select("user_id", F.explode(F.array(F.lit("late"), F.lit("new"))).alias("client"), "half").select("user_id", "client", F.when(F.col("client") == "late", F.col("half")).alias("last_id"))
    return monitor.resumed(events, clients, "user_id", "event_id", 20).select("client", "user_id", "event_id")


@register("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) AS r WHERE n <= 100")
def sse_buffer_drop(spark, sf_dir):
    return monitor.newest(_events(spark, sf_dir).select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], monitor.QUEUE)


@register("""SELECT event_id, 'id: ' || event_id || chr(10) || 'data: {"type":"' || event_type || '","data":' || coalesce(to_json(props)::VARCHAR, 'null') || ',"ts":' || epoch_us(ts) // 1000000 || ',"section":-1,"total":0}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark, sf_dir):
    """Events as frames, with whole seconds as their time."""
    at = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long")
    return _events(spark, sf_dir).select("event_id", monitor.sse_frame(F.col("event_id"), F.col("event_type"), F.col("props"), at).alias("frame"))


@register("SELECT event_type AS kind, count(*) FILTER (value < 10) AS hits, count(*) FILTER (value >= 10) AS misses, round(count(*) FILTER (value < 10) / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, sf_dir):
    """Requests below ten count as hits."""
    return monitor.hit_rate(_events(spark, sf_dir).select(F.col("event_type").alias("kind"), (F.col("value") < 10).alias("hit")), "hit", ["kind"])


#: Events of each user in order, with their seconds, for recursive SQL.
_ORDERED = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@register(f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT event_id, user_id, n, t, 2.0::DOUBLE AS had, 1.0::DOUBLE AS tokens FROM e WHERE n = 1
 UNION ALL SELECT e.event_id, e.user_id, e.n, e.t, least(2.0::DOUBLE, r.tokens + (e.t - r.t) * (1::DOUBLE / 3600)), CASE WHEN least(2.0::DOUBLE, r.tokens + (e.t - r.t) * (1::DOUBLE / 3600)) >= 1 THEN least(2.0::DOUBLE, r.tokens + (e.t - r.t) * (1::DOUBLE / 3600)) - 1 ELSE least(2.0::DOUBLE, r.tokens + (e.t - r.t) * (1::DOUBLE / 3600)) END
 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, user_id, had >= 1 AS allowed FROM r""")
def token_bucket(spark, sf_dir):
    """A bucket for each user: one token an hour, two at most."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id")
    return control.token_bucket(events, "user_id", "ts", ["ts", "event_id"], 1 / 3600, 2.0).select("event_id", "user_id", "allowed")


@register(f"""WITH RECURSIVE {_ORDERED.replace("epoch_us(ts) / 1e6", "epoch_us(ts)")}, r AS (SELECT event_id, user_id, n, t + 3600000000 AS full_at, true AS granted, 0::BIGINT AS waited_us FROM e WHERE n = 1
 UNION ALL SELECT event_id, user_id, n, CASE WHEN wait <= 1800000000 THEN greatest(full_at, t) + 3600000000 ELSE full_at END, wait <= 1800000000, CASE WHEN wait <= 1800000000 THEN wait END
 FROM (SELECT e.event_id, e.user_id, e.n, e.t, r.full_at, greatest(0, r.full_at - 3600000000 - e.t) AS wait FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)) SELECT event_id, granted, waited_us FROM r""")
def waiting_tokens(spark, sf_dir):
    """A bucket for each user, one token an hour, two at most; an event waits half an hour at most."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id")
    return control.waiting_tokens(events, "user_id", "ts", ["ts", "event_id"], 1 / 3600, 2, 1800.0).select("event_id", "granted", "waited_us")


@register("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT event_id, user_id, n, false AS repeated, [k] AS kept FROM e WHERE n = 1
 UNION ALL SELECT e.event_id, e.user_id, e.n, list_contains(kept, k), CASE WHEN list_contains(kept, k) THEN kept WHEN len(kept) >= 3 THEN list_append(kept[2:], k) ELSE list_append(kept, k) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, repeated FROM r""")
def bounded_keys(spark, sf_dir):
    """A table of the newest three event types for each user."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return control.repeated_keys(events, "user_id", "event_type", "ts", ["ts", "event_id"], 3).select("event_id", "repeated")


_AT = "CASE WHEN r.state = 'open' AND e.t - r.opened >= 3600 THEN 'half_open' ELSE r.state END"
_GOOD = "(e.event_type <> 'error')"


@register(f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT event_id, user_id, n, 'closed' AS state, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failures, 0::DOUBLE AS opened, true AS admitted FROM e WHERE n = 1
 UNION ALL SELECT event_id, user_id, n, CASE WHEN at_ = 'open' THEN 'open' WHEN good THEN 'closed' WHEN at_ = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE at_ END, CASE WHEN at_ = 'open' THEN failures WHEN good THEN 0 ELSE failures + 1 END,
  CASE WHEN at_ <> 'open' AND NOT good AND (at_ = 'half_open' OR failures + 1 >= 2) THEN t ELSE opened END, at_ <> 'open'
 FROM (SELECT e.event_id, e.user_id, e.n, e.t, {_AT} AS at_, {_GOOD} AS good, r.failures, r.opened FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)) SELECT event_id, user_id, state, admitted FROM r""")
def circuit_breaker(spark, sf_dir):
    """A breaker for each user: two errors in a row open it for an hour."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("success"))
    return control.circuit_breaker(events, "user_id", "ts", ["ts", "event_id"], "success", 2, 3600.0).select("event_id", "user_id", "state", "admitted")


@register(f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT event_id, user_id, n, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, CASE WHEN event_type = 'error' THEN t ELSE 0 END AS since, true AS admitted FROM e WHERE n = 1
 UNION ALL SELECT event_id, user_id, n, CASE WHEN NOT ok THEN failed WHEN good THEN 0 ELSE failed + 1 END, CASE WHEN NOT ok THEN since WHEN good THEN 0 ELSE t END, ok
 FROM (SELECT e.event_id, e.user_id, e.n, e.t, r.failed, r.since, {_GOOD} AS good, r.failed < 2 OR e.t - r.since >= 36000 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)) SELECT event_id, admitted, failed < 2 AS healthy FROM r""")
def provider_cooldown(spark, sf_dir):
    """A provider for each user: two errors in a row make it unhealthy, and it is tried again after ten hours."""
    calls = _events(spark, sf_dir).select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("success"))
    return control.provider_calls(calls, "user_id", "ts", ["ts", "event_id"], "success", 2, 36000.0).select("event_id", "admitted", "healthy")


@register(f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT event_id, user_id, n, false AS hit, [{{'k': event_type, 'i': t}}] AS cache FROM e WHERE n = 1
 UNION ALL SELECT event_id, user_id, n, hit, CASE WHEN hit THEN list_append(others, found[1]) ELSE list_append(CASE WHEN len(others) >= 3 THEN others[len(others) - 1:] ELSE others END, {{'k': event_type, 'i': t}}) END
 FROM (SELECT *, len(found) > 0 AND t - found[1].i <= 86400 AS hit FROM (SELECT e.event_id, e.user_id, e.n, e.t, e.event_type, list_filter(r.cache, lambda x: x.k = e.event_type) AS found, list_filter(r.cache, lambda x: x.k <> e.event_type) AS others FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
 SELECT event_id, hit FROM r""")
def cache_hits(spark, sf_dir):
    """A cache of three event types for each user; entries live for a day."""
    requests = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return control.lru_hits(requests, "user_id", "event_type", "ts", ["ts", "event_id"], 3, 86400.0).select("event_id", "hit")


# -- logs, alerts, metrics ---------------------------------------------------------------------


@register(shared_sql("log_filter"))
def log_filter(spark, sf_dir):
    own = monitor.chosen(_events(spark, sf_dir), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), event_type=["error", "signup"], user_id=None)
    return own.select("event_id", "user_id", "event_type")


@register("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def alert_recent(spark, sf_dir):
    """The newest two hundred errors (a ring buffer)."""
    return monitor.chosen(_events(spark, sf_dir), event_type="error").orderBy(F.desc("ts"), F.desc("event_id")).limit(monitor.ALERTS).select("event_id", "user_id")


_LE = ", ".join(f"('{b}', {b}::DOUBLE)" for b in monitor.BUCKETS)


_HISTOGRAM = f"""WITH l AS (SELECT * FROM (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000), b AS (SELECT * FROM (VALUES {_LE}) t(le, bound))
SELECT name, le, count(*) FILTER (value <= bound)::DOUBLE AS n FROM l, b GROUP BY name, le UNION ALL SELECT name, '+Inf', count(*) FROM l GROUP BY name UNION ALL SELECT name, 'count', count(*) FROM l GROUP BY name UNION ALL SELECT name, 'sum', round(sum(value), 6) FROM l GROUP BY name"""


@register(_HISTOGRAM)
def metrics_histogram(spark, sf_dir):
    return monitor.histogram(_events(spark, sf_dir), "event_type", "value", [F.desc("ts"), F.desc("event_id")])


@register(f"""SELECT '# TYPE value histogram' AS line UNION ALL SELECT CASE le WHEN 'sum' THEN 'value_sum{{type="' || name || '"}} ' || CAST(n AS DECIMAL(18,2)) WHEN 'count' THEN 'value_count{{type="' || name || '"}} ' || n::BIGINT ELSE 'value_bucket{{type="' || name || '",le="' || le || '"}} ' || n::BIGINT END FROM ({_HISTOGRAM})""")
def prometheus_histogram(spark, sf_dir):
    rows = monitor.histogram(_events(spark, sf_dir), "event_type", "value", [F.desc("ts"), F.desc("event_id")])
    return monitor.prometheus_histogram(rows, "value", "type")


@register("""SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT 'last_event{type="' || event_type || '"} ' || max(event_id) FROM events GROUP BY event_type UNION ALL SELECT '# TYPE events_total counter' UNION ALL SELECT '# TYPE last_event gauge'""")
def prometheus_text(spark, sf_dir):
    own = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    row = lambda name, kind, value: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(value).alias("value"))
    return monitor.prometheus(own.select("event_type", F.inline(F.array(row("events_total", "counter", "n"), row("last_event", "gauge", "last")))), "name", "kind", "event_type", "value")


@register("SELECT event_id, count(*) OVER w AS n, avg(CAST(round(value * 100) AS BIGINT)) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_latency(spark, sf_dir):
    """The mean of each user's last hundred values, in cents, so that it is exact."""
    return monitor.rolling(_events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long")), "user_id", ["ts", "event_id"], "cents").select("event_id", "n", "mean")


@register("SELECT user_id AS agent, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, NOT (count(*) > 10 AND count(*) FILTER (event_type = 'error') * 2 >= count(*)) AS healthy FROM events GROUP BY user_id")
def agent_health(spark, sf_dir):
    return monitor.agent_health(_events(spark, sf_dir).select("user_id", (F.col("event_type") != "error").alias("ok")), "user_id", "ok")


_CHECK = "CASE WHEN user_id % 7 = 0 THEN 'error' WHEN user_id % 11 = 0 THEN 'warning' ELSE 'ok' END"


@register(f"SELECT count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'warning') AS warnings, count(*) FILTER (s = 'error') AS errors, CASE WHEN bool_and(s = 'ok') THEN 'healthy' ELSE 'degraded' END AS overall, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT user_id::VARCHAR AS c FROM events WHERE {_CHECK} <> 'ok' ORDER BY c LIMIT 100)) AS failing FROM (SELECT DISTINCT user_id::VARCHAR AS c, {_CHECK} AS s FROM events)")
def startup_report(spark, sf_dir):
    """A component for each user, its state by number."""
    checks = _events(spark, sf_dir).selectExpr("cast(user_id AS string) AS component", f"{_CHECK} AS status").distinct()
    return monitor.component_report(checks, "component", "status")


@register("SELECT event_id, greatest(0.1, least(120.0::DOUBLE, power(2.0::DOUBLE, event_id % 10)))::DOUBLE AS exponential, greatest(0.1, least(120.0::DOUBLE, 15.0::DOUBLE * (event_id % 10 + 1)))::DOUBLE AS linear, (greatest(0.1, 0.01))::DOUBLE AS fixed, round(greatest(0.1::DOUBLE, least(120.0::DOUBLE, power(2.0::DOUBLE, event_id % 10)) * (1.0::DOUBLE + ((event_id * 7919 + 42) % 2001 - 1000) / 1000 * 0.1::DOUBLE)), 6) AS jittered FROM events WHERE event_type = 'error'")
def retry_backoff(spark, sf_dir):
    attempt = F.col("event_id") % 10 + 1
    return _events(spark, sf_dir).filter("event_type = 'error'").select("event_id", monitor.backoff("exponential", attempt).alias("exponential"), monitor.backoff("linear", attempt, 15.0).alias("linear"), monitor.backoff("fixed", attempt, 0.01).alias("fixed"), F.round(monitor.backoff("exponential", attempt, jitter=monitor.seeded_jitter(F.col("event_id"), 42)), 6).alias("jittered"))


# -- versions ----------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), "text")


_VERSIONS = "SELECT doc_id, source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, sha256(text) AS digest, strlen(text)::BIGINT AS size, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents"


@register(_VERSIONS)
def version_commit(spark, sf_dir):
    return versions.committed(_files(spark, sf_dir), "file", "doc_id", "text").select("doc_id", "file", "version", "digest", "size", "n_lines")


@register(f"SELECT file, version, doc_id, size FROM ({_VERSIONS})")
def version_history(spark, sf_dir):
    return versions.committed(_files(spark, sf_dir), "file", "doc_id", "text").select("file", "version", "doc_id", "size")


@register(f"SELECT file, version, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY version DESC) AS n FROM ({_VERSIONS})) WHERE n <= 50")
def version_prune(spark, sf_dir):
    return versions.pruned(versions.committed(_files(spark, sf_dir), "file", "doc_id", "text"), "file").select("file", "version", "doc_id")


@register("SELECT count(DISTINCT source) AS files, count(*) AS versions, coalesce(sum(strlen(text)), 0)::BIGINT AS total_bytes FROM documents")
def version_stats(spark, sf_dir):
    return versions.stored(versions.with_digests(_files(spark, sf_dir), "text"), "file")


def _backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), (F.col("doc_id") % 120).alias("age"))


@register("SELECT file, doc_id FROM (SELECT source AS file, doc_id, doc_id % 120 AS age, row_number() OVER (PARTITION BY source ORDER BY doc_id % 120, doc_id DESC) AS n FROM documents) AS r WHERE age <= 7 AND n <= 20")
def backup_ttl(spark, sf_dir):
    return versions.fresh_backups(_backups(spark, sf_dir), "file", "age", [F.col("age"), F.desc("doc_id")]).select("file", "doc_id")


@register(shared_sql("backup_tiered"))
def backup_tiered(spark, sf_dir):
    return versions.tiered_backups(_backups(spark, sf_dir), "file", "age", [F.col("age"), F.desc("doc_id")]).select("file", "doc_id")


_SIZES = "SELECT doc_id, s, l, lag(s) OVER w AS ps, lag(l) OVER w AS pl FROM (SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END AS s, n_chars % 50 AS l FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id)"


@register(f"""SELECT doc_id, CASE WHEN s = 0 THEN 'P0' WHEN ps > 0 AND (s < 0.5 * ps OR s > 5 * ps) THEN 'P1' ELSE 'ok' END AS agent, CASE WHEN s = 0 THEN 'P0' WHEN ps > 0 AND (s < 0.5 * ps OR s > 10 * ps) THEN 'P1' WHEN pl > 0 AND l < 0.7 * pl THEN 'P1' ELSE 'ok' END AS script FROM ({_SIZES})""")
def write_validate(spark, sf_dir):
    """Each document as a write of its source's file, by the limits of both safe writers."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.struct(F.when(F.col("doc_id") % 17 == 0, 0).otherwise(F.col("n_chars")).alias("s"), (F.col("n_chars") % 50).alias("l")).alias("v"))
    own = versions.with_previous(rows, "file", "doc_id", "v")
    return own.select("doc_id", versions.write_level(F.col("v.s"), F.col("previous.s")).alias("agent"), versions.script_level(F.col("v.s"), F.col("previous.s"), F.col("v.l"), F.col("previous.l")).alias("script"))


# -- further filters of documents --------------------------------------------------------------


@register(shared_sql("query_dedup"))
def query_dedup(spark, sf_dir):
    own = load(spark, sf_dir, "conversations").filter("role = 'user' AND trim(text) <> ''").select("conv_id", "turn", F.trim("text").alias("query"))
    return monitor.newest(own, ["query"], [F.col("conv_id"), F.col("turn")], 1)


@register(shared_sql("chunk_dedup"))
def chunk_dedup(spark, sf_dir):
    titled = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title")).filter("trim(title) <> ''").withColumn("k", F.left(F.lower(F.trim("title")), F.lit(50)))
    return monitor.newest(titled, ["k"], [F.col("page_id")], 1).select("page_id", "title")


@register(shared_sql("polish_gate"))
def polish_gate(spark, sf_dir):
    text = F.col("text")
    skip = (F.length(text) >= 500) & text.rlike(r"\]\(http") & (F.regexp_count(text, F.lit("(?m)^## ")) >= 3)
    return _md(spark, sf_dir).select("doc_id", skip.alias("skip"))


@register(shared_sql("lint_p0"))
def lint_p0(spark, sf_dir):
    own = _md(spark, sf_dir).select("doc_id", F.when(F.trim("text") == "", "content").when(F.octet_length("text") > 10 << 20, "size").alias("issue"))
    return own.filter("issue IS NOT NULL")


@register(shared_sql("lint_missing_sections"))
def lint_missing_sections(spark, sf_dir):
    has = {"faq": "(?i)常见问题|faq", "practice": "(?i)最佳实践|best[^\\n]practice", "trouble": "(?i)故障排查|troubleshoot"}
    return _md(spark, sf_dir).select("doc_id", *((~F.col("text").rlike(p)).alias(n) for n, p in has.items()))
