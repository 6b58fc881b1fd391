"""What a running engine counts: costs, quality feedback, queues, messages, streams, logs, metrics. Expressions and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import scans
from scriptorium.tables import fresh, newest

# Fixed values of the monitoring rules.
CJK = r"[\x{4e00}-\x{9fff}]"
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
OBSERVATIONS, MAX_DELAY, LEAST_DELAY = 1000, 120.0, 0.1
WEAK_SCORE, WEAK_RATE, LEAST_SAMPLES = 70, 0.4, 3
WATERMARK, BATCH, QUEUE, HISTORY, ALERTS, TASKS = 400, 50, 100, 500, 200, 100
STATES = ("pending", "running", "done", "failed", "cancelled")


def count_if(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition).cast("long")


def chosen(rows: DataFrame, time: str | None = None, since: Column | None = None, **equal: object) -> DataFrame:
    """``rows`` whose columns equal the values given (a list: any of them; None: not asked), not before ``since``."""
    conditions = [F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in equal.items() if v is not None]
    if since is not None:
        conditions.append(F.col(time) >= since)
    return rows.filter(reduce(Column.__and__, conditions)) if conditions else rows


# -- costs -------------------------------------------------------------------------------------


def token_estimate(text: Column) -> Column:
    """Half of the Chinese characters and a quarter of the others, each rounded down, and one; nothing for an empty text."""
    wide = F.regexp_count(text, F.lit(CJK))
    return F.when(F.length(text) == 0, 0).otherwise(F.floor(wide / 2) + F.floor((F.length(text) - wide) / 4) + 1).cast("long")


def with_cost(calls: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> DataFrame:
    """``calls`` (provider, prompt, completion) with cost: the prices of 1,000 tokens by provider, ``default`` for others."""
    prompt, completion = (reduce(lambda c, item: c.when(F.col("provider") == item[0], item[1][side]), prices.items(), F).otherwise(default[side]) for side in (0, 1))  # noqa: B023
    return calls.withColumn("cost", (F.col("prompt") * prompt + F.col("completion") * completion) / 1000)


def exact_sum(value: Column) -> Column:
    """The sum of doubles, rounded once: the order of rows doesn't matter, and one or two values add up as ``+`` does.

    Each value is a whole number of 2^-30 and a rest in whole 2^-83 (none of a cost is smaller), which are summed as decimals.
    Where a value isn't finite, or 2^32 or more, the plain sum stands.
    """
    fits = F.abs(value) < 2.0**32
    scaled = F.when(fits, value * 2.0**30)
    whole = F.floor(scaled)
    rest = F.sum(F.floor((scaled - whole) * 2.0**53).cast("decimal(16,0)"))
    carry = F.floor(rest / F.lit(2**53).cast("decimal(16,0)")).cast("decimal(28,0)")
    high, low = F.sum(whole.cast("decimal(19,0)")) + carry, rest - carry * F.lit(2**53).cast("decimal(16,0)")
    exact = high.cast("double") / 2.0**30 + low.cast("double") / 2.0**83
    return F.when(F.max(F.abs(value)) < 2.0**32, exact).otherwise(F.sum(value))


def rounded(value: Column, digits: int) -> Column:
    """To ``digits`` decimals, ties away from zero, decided on the scaled double and not on its shortest decimal form."""
    return F.round(value * 10.0**digits) / 10.0**digits


def cost_by(calls: DataFrame, by: list[str], since: Column | None = None, time: str = "ts") -> DataFrame:
    """Calls, tokens and cost of each group of ``by``, not before ``since``."""
    own = calls if since is None else calls.filter(F.col(time) >= since)
    sums = [F.sum(c).cast("long").alias(f"{c}_tokens") for c in ("prompt", "completion")]
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *sums, F.sum(F.col("prompt") + F.col("completion")).cast("long").alias("total_tokens"), rounded(exact_sum(F.col("cost")), 6).alias("cost"))


def cost_of_task(calls: DataFrame, task: str) -> DataFrame:
    """(task, provider, total, cost): each provider's and, with ``total`` true and provider null, the task's; calls without a provider or a task are groups of their own."""
    sets = calls.groupingSets([[F.col(task), F.col("provider")], [F.col(task)]], task, "provider")
    return sets.agg((F.grouping("provider") == 1).alias("total"), rounded(exact_sum(F.col("cost")), 6).alias("cost"))


def budget(calls: DataFrame, limit: float) -> DataFrame:
    """(calls, total, remaining, exceeded); an empty table spends nothing."""
    total = F.coalesce(exact_sum(F.col("cost")), F.lit(0.0))
    return calls.agg(F.count(F.lit(1)).alias("calls"), rounded(total, 4).alias("total"), rounded(limit - total, 4).alias("remaining"), (total > limit).alias("exceeded"))


def kept_since(rows: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the latest one (a single value is broadcast)."""
    (end,) = fresh(rows, "end")
    latest = rows.agg(F.max(time).alias(end))
    return rows.join(F.broadcast(latest), F.col(time) >= F.col(end) - F.make_dt_interval(F.lit(days)), "left_semi")


# -- quality feedback --------------------------------------------------------------------------


def weak_patterns(scores: DataFrame, dimension: str, score: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """(dimension, n, avg_score, weak_rate, problematic) of dimensions with ``least`` scores; the unrounded rate decides."""
    rate = F.avg((F.col(score) < WEAK_SCORE).cast("double"))
    own = scores.groupBy(F.col(dimension).alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(score).cast("double")), 1).alias("avg_score"), F.round(rate, 2).alias("weak_rate"), (rate > WEAK_RATE).alias("problematic"))
    return own.filter(F.col("n") >= least)


def recommendations(patterns: DataFrame, most: int = 3) -> DataFrame:
    """(dimension, weak_rate, advice) of the weakest problematic dimensions (a top-k report)."""
    own = patterns.filter("problematic").orderBy(F.desc("weak_rate"), "dimension").limit(most)
    percent = F.format_string("%.0f", F.col("weak_rate") * 100)
    return own.select("dimension", "weak_rate", F.concat(F.lit("improve "), "dimension", F.lit(": weak in "), percent, F.lit("% of "), F.col("n").cast("string"), F.lit(" samples")).alias("advice"))


# -- queues and tasks --------------------------------------------------------------------------


def by_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def batch_summary(tasks: DataFrame, status: str) -> DataFrame:
    """(total, a count for each of STATES, success_rate); 0 for an empty table."""
    total = F.count(F.lit(1))
    rate = F.when(total > 0, F.round(count_if(F.col(status) == "done") / total, 4)).otherwise(0.0)
    return tasks.agg(total.alias("total"), *(count_if(F.col(status) == s).alias(s) for s in STATES), rate.alias("success_rate"))


def latest_state(changes: DataFrame, key: str, status: str, order: list[str], recover: bool = False) -> DataFrame:
    """(key, status): the last status of each task; ``recover`` puts running ones back to pending. Map-side aggregation only."""
    last = changes.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))
    return last.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status"))) if recover else last


def transition_ok(before: Column, after: Column) -> Column:
    """Whether a task may go from a state to the next: pending to running or cancelled, running to done, failed, cancelled or back to pending."""
    return ((before == "pending") & after.isin("running", "cancelled")) | ((before == "running") & after.isin("done", "failed", "cancelled", "pending"))


def acquired(tasks: DataFrame, key: str, order: list[str], row: str) -> DataFrame:
    """(key, row) of the oldest pending task of each queue; map-side aggregation only."""
    return tasks.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias(row))


def trimmed_history(tasks: DataFrame, finished: Column, order: list[Column], key: list[str], most: int = TASKS) -> DataFrame:
    """Open tasks, and the ``most`` finished ones that come first in ``order``, of each key."""
    return tasks.filter(~finished).unionByName(newest(tasks.filter(finished), key, order, most))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done / total * 100)).otherwise(0).cast("long")


def pool_merge(results: DataFrame, node: str, extend: list[str]) -> DataFrame:
    """(task, base, total, query_count, engines_used, first_result) of pool instances' results (task, node, at, rows, query_count, engines).

    ``name_pool_i`` merge into ``name``: nodes in ``extend`` add their rows and queries and unite their engines; of others the
    first result that isn't empty stands.
    """
    base = F.regexp_replace(node, "_pool_.*$", "")
    own = results.withColumn("base", base).filter(F.col(node).contains("_pool_"))
    merged = own.groupBy("task", "base").agg(
        F.sum(F.size("rows")).cast("long").alias("total"),
        F.sum("query_count").cast("long").alias("query_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines")))), ",").alias("engines_used"),
        F.min_by(F.array_join("rows", ","), F.when(F.size("rows") > 0, F.col("at"))).alias("first_result"),
    )
    extends = F.col("base").isin(*extend)
    return merged.select("task", "base", *(F.when(extends, F.col(c)).alias(c) for c in ("total", "query_count", "engines_used")), F.when(~extends, F.col("first_result")).alias("first_result"))


def dependency_inputs(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(node, at, of, value): for each node of ``edges`` (node, dependency, at) a row for each result (node, value) of a dependency; pool suffixes don't count. A node's inputs in order are those by (at, of, value)."""
    plain = lambda c: F.regexp_replace(c, "_pool_.*$", "")
    own = edges.select("node", "at", plain(F.col("dependency")).alias("base"))
    return own.join(results.select(plain(F.col("node")).alias("base"), F.col("node").alias("of"), "value"), "base").select("node", "at", "of", "value")


# -- messages ----------------------------------------------------------------------------------


def message_metrics(log: DataFrame, topic: str, kind: str) -> DataFrame:
    """(topic, sent, received, failed, retried, dlq): counts of a message log by its kinds."""
    return log.groupBy(F.col(topic).alias("topic")).agg(*(count_if(F.col(kind) == k).alias(k) for k in ("sent", "received", "failed", "retried", "dlq")))


def queue_depth(log: DataFrame, queue: str, change: str, order: list[str], limit: int = WATERMARK) -> DataFrame:
    """``log`` with depth (messages not yet delivered after the row) and busy: a publish that finds the queue at ``limit`` is refused and leaves the depth as it is.

    ``change`` is 1 for a publish and -1 for a delivery; one from an empty queue delivers nothing. A queue with very many rows is split.
    """
    (before,) = fresh(log, "before")
    own = scans.running(log, queue, order, change, before, 0, limit)
    depth = F.least(F.lit(limit), F.greatest(F.lit(0), F.col(before) + F.coalesce(F.col(change), F.lit(0)))).cast("long")
    return own.withColumn("depth", depth).withColumn("busy", (F.col(change) > 0) & (F.col(before) >= limit)).drop(before)


def depth_summary(depths: DataFrame, queue: str) -> DataFrame:
    """(queue, peak_depth, watermark_hits, undelivered) of queue_depth's rows."""
    return depths.groupBy(F.col(queue).alias("queue")).agg(F.max("depth").alias("peak_depth"), count_if("busy").alias("watermark_hits"), F.max_by("depth", "at").alias("undelivered"))


def dead_letters(messages: DataFrame, key: str, failed: Column, order: list[str]) -> DataFrame:
    """One row for each failed message id, the last failure; ``replay_count`` says how often it failed before."""
    last = messages.filter(failed).groupBy(key).agg(F.max(F.struct(*order)).alias("_last"), (F.count(F.lit(1)) - 1).alias("replay_count"))
    return last.select(key, "_last.*", "replay_count")


def replayed(letters: DataFrame, most: int = 3) -> DataFrame:
    """Dead letters to publish again: fewer than ``most`` replays so far, the count raised by this one."""
    return letters.filter(F.col("replay_count") < most).withColumn("replay_count", F.col("replay_count") + 1)


def drained(messages: DataFrame, queue: str, order: list[str], most: int = BATCH) -> DataFrame:
    """``messages`` with batch: the number, from 0, of the micro-batch of ``most`` that delivers each. A queue with very many rows is split."""
    one, place = fresh(messages, "one", "place")
    own = scans.running(messages.withColumn(one, F.lit(1)), queue, order, one, place)
    return own.withColumn("batch", F.floor(F.col(place) / most).cast("long")).drop(one, place)


def answered(messages: DataFrame, correlation: str, kind: str, time: str) -> DataFrame:
    """(correlation, asked, answered, waited): each request and the first response with its id, null without one. One aggregation, no join."""
    when = lambda k: F.min(F.when(F.col(kind) == k, F.col(time)))
    own = messages.groupBy(correlation).agg(when("request").alias("asked"), when("response").alias("answered"))
    return own.filter("asked IS NOT NULL").withColumn("waited", F.col("answered") - F.col("asked"))


def subscribers_of(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each message with its topic's subscribers (topic, subscriber, priority) and their place by priority, then name.

    Places come from the subscribers alone; Spark broadcasts them if their size allows, and splits hot topics if not.
    """
    places = subscribers.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("priority", "subscriber")).cast("long"))
    return messages.join(places.select("topic", "subscriber", "place"), "topic")


def health(messages: DataFrame, letters: DataFrame, keys: DataFrame, most_letters: float = 0.1) -> DataFrame:
    """(messages, dlq, processed_keys, status): ``degraded`` if more than the share ``most_letters`` of all messages are dead letters, else ``ok``."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = one(messages, "messages").crossJoin(one(letters, "dlq")).crossJoin(one(keys, "processed_keys"))  # single rows
    return rows.withColumn("status", F.when(F.col("dlq") > most_letters * F.col("messages"), "degraded").otherwise("ok"))


# -- streams -----------------------------------------------------------------------------------


def stream_metrics(events: DataFrame, kind: str, time: str) -> DataFrame:
    """(kind, n, events_per_sec, avg_latency): the seconds between first and last event, spread over their number."""
    span = (F.max(time).cast("double") - F.min(time).cast("double"))
    n = F.count(F.lit(1))
    return events.groupBy(F.col(kind).alias("kind")).agg(n.alias("n"), F.round(F.when(span > 0, n / span).otherwise(0.0), 6).alias("events_per_sec"), F.round(span / n, 3).alias("avg_latency"))


def resumed(events: DataFrame, clients: DataFrame, stream: str, event: str, history: int = HISTORY) -> DataFrame:
    """Events behind each client's last id (clients: stream, client, last_id) among the newest ``history`` of their stream."""
    kept = newest(events, [stream], [F.col(event).desc()], history)
    return clients.join(kept, stream).filter(F.col("last_id").isNull() | (F.col(event) > F.col("last_id"))).select("client", stream, event)


def sse_frame(event: Column, kind: Column, data: Column, time: Column, section: Column | None = None, total: Column | None = None) -> Column:
    """An event of the text/event-stream format: its id, and one line of JSON with type, data, ts, section and total. Nulls are written as null; line breaks are escaped."""
    fields = F.struct(kind.alias("type"), data.alias("data"), time.alias("ts"), (F.lit(-1) if section is None else section).alias("section"), (F.lit(0) if total is None else total).alias("total"))
    return F.concat(F.lit("id: "), event.cast("string"), F.lit("\ndata: "), F.to_json(fields, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def hit_rate(requests: DataFrame, hit: str, by: list[str]) -> DataFrame:
    """(*by, hits, misses, hit_rate); without requests there is no row."""
    hits = count_if(F.col(hit))
    return requests.groupBy(*by).agg(hits.alias("hits"), count_if(~F.col(hit)).alias("misses"), F.round(hits / F.count(F.lit(1)), 6).alias("hit_rate"))


# -- metrics -----------------------------------------------------------------------------------


def histogram(values: DataFrame, name: str, value: str, order: list[Column], most: int = OBSERVATIONS) -> DataFrame:
    """(name, le, n): for the last ``most`` values of each name the cumulative counts of BUCKETS, ``+Inf``, and the rows ``sum`` and ``count``."""
    own = newest(values, [name], order, most)
    sums = own.groupBy(name).agg(*(count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)), F.count(F.lit(1)).alias("count"), F.round(F.sum(value), 6).alias("sum"))
    row = lambda le, n: F.struct(F.lit(le).alias("le"), n.cast("double").alias("n"))
    rows = [*(row(str(b), F.col(f"b{i}")) for i, b in enumerate(BUCKETS)), row("+Inf", F.col("count")), row("count", F.col("count")), row("sum", F.col("sum"))]
    return sums.select(F.col(name).alias("name"), F.inline(F.array(*rows)))


def prometheus(metrics: DataFrame, name: str, kind: str, label: str, value: str) -> DataFrame:
    """(line): text lines of counters and gauges, a type line before each metric's samples."""
    types = metrics.select(F.concat(F.lit("# TYPE "), name, F.lit(" "), kind).alias("line")).distinct()
    sample = F.concat(F.col(name), F.lit('{type="'), F.col(label), F.lit('"} '), F.col(value).cast("string"))
    return types.unionByName(metrics.select(sample.alias("line")))


def prometheus_histogram(rows: DataFrame, metric: str, label: str) -> DataFrame:
    """(line): text lines of ``histogram``'s rows, cumulative buckets with their bounds, sum and count, behind a type line."""
    of = F.concat(F.lit(f'{{{label}="'), "name", F.lit('"'))
    whole, cents = F.col("n").cast("long").cast("string"), F.col("n").cast("decimal(18,2)").cast("string")
    line = F.when(F.col("le") == "sum", F.concat(F.lit(f"{metric}_sum"), of, F.lit("} "), cents)).when(F.col("le") == "count", F.concat(F.lit(f"{metric}_count"), of, F.lit("} "), whole))
    line = line.otherwise(F.concat(F.lit(f"{metric}_bucket"), of, F.lit(',le="'), "le", F.lit('"} '), whole))
    types = rows.select(F.lit(f"# TYPE {metric} histogram").alias("line")).limit(1)
    return types.unionByName(rows.select(line.alias("line")))


def rolling(events: DataFrame, key: str, order: list[str], value: str, most: int = 100) -> DataFrame:
    """``events`` with n and mean of the last ``most`` values so far."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - most, 0)
    return events.withColumn("n", F.count(F.lit(1)).over(last)).withColumn("mean", F.avg(value).over(last))


def agent_health(calls: DataFrame, agent: str, success: str, least: int = 10) -> DataFrame:
    """(agent, n, errors, healthy): unhealthy with more than ``least`` calls of which half or more failed."""
    errors = count_if(~F.col(success))
    return calls.groupBy(F.col(agent).alias("agent")).agg(F.count(F.lit(1)).alias("n"), errors.alias("errors"), (~((F.count(F.lit(1)) > least) & (errors * 2 >= F.count(F.lit(1))))).alias("healthy"))


def component_report(checks: DataFrame, component: str, status: str, most: int = 100) -> DataFrame:
    """(ok, warnings, errors, overall, failing): degraded if any component isn't ok; of those that aren't the first ``most`` names (a report) in order."""
    bad = checks.filter(F.col(status) != "ok").select(F.col(component).alias("name")).distinct().orderBy("name").limit(most)
    names = bad.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("failing"))
    sums = checks.agg(count_if(F.col(status) == "ok").alias("ok"), count_if(F.col(status) == "warning").alias("warnings"), count_if(F.col(status) == "error").alias("errors"), F.when(F.coalesce(F.bool_and(F.col(status) == "ok"), F.lit(True)), "healthy").otherwise("degraded").alias("overall"))
    return sums.crossJoin(names)  # single rows


def hook_matches(event: Column, pattern: Column) -> Column:
    """A pattern is ``*``, the event itself, or ``prefix.*`` for events that begin with ``prefix.``."""
    prefix = F.substr(pattern, F.lit(1), F.length(pattern) - 1)
    return (pattern == "*") | (pattern == event) | (pattern.endswith(".*") & event.startswith(prefix))


def backoff(kind: str, attempt: Column, base: float = 1.0, jitter: Column | float = 0.0) -> Column:
    """Seconds before an attempt (from 1): ``exponential``, ``linear`` or ``fixed``, at most 120, moved by the share ``jitter``, at least 0.1."""
    delay = {"exponential": base * F.pow(F.lit(2.0), attempt - 1), "linear": base * attempt, "fixed": F.lit(base)}[kind]
    return F.greatest(F.lit(LEAST_DELAY), F.least(F.lit(MAX_DELAY), delay.cast("double")) * (F.lit(1.0) + jitter))


def seeded_jitter(number: Column, seed: int, share: float = 0.1) -> Column:
    """A share from ``-share`` to ``share`` for ``backoff``, the same for a number and seed on every run."""
    return (F.pmod(number * 7919 + seed, F.lit(2001)) - 1000) / 1000 * share
