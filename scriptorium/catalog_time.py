"""Queries over time: as-of and interval joins, windows, late rows, sketches, levels of plans, ranks of links."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import graph, layout, sketches, timejoin
from scriptorium.plans import dag
from scriptorium.registry import register
from scriptorium.tables import load


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")


@register("SELECT l.event_id, r.event_id AS error_id, r.value AS error_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def purchase_as_of_error(spark, sf_dir):
    """Each purchase with its user's latest error."""
    events = _events(spark, sf_dir)
    errors = events.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    return timejoin.as_of(events.filter("event_type = 'purchase'"), errors, "user_id", "ts", ["error_id", "error_value"], "error_id").select("event_id", "error_id", "error_value")


@register("SELECT event_id, e.error_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c JOIN (SELECT event_id AS error_id, user_id, ts AS a, ts + to_microseconds((1000000 * 600 * (1 + event_id % 7) * (1 + event_id % 7))::BIGINT) AS b FROM events WHERE event_type = 'error') e ON c.user_id = e.user_id AND c.ts BETWEEN e.a AND e.b")
def clicks_during_trouble(spark, sf_dir):
    """Clicks of a user within the time that follows one of their errors: ten minutes to eight hours, by its number."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = _events(spark, sf_dir).withColumn("at", us)
    turns = 1 + F.col("event_id") % 7
    trouble = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("at").alias("since"), (F.col("at") + 600_000_000 * turns * turns).alias("until"))
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "at")
    return timejoin.interval_join(clicks, trouble, "at", "since", "until", 600e6, "user_id").select("event_id", "error_id")


_SESSIONS = "SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, (coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6' HOUR, true))::INT AS opens FROM events)) GROUP BY user_id, island"


@register(_SESSIONS)
def user_sessions(spark, sf_dir):
    """Sessions that six hours without an event end."""
    return timejoin.sessions(_events(spark, sf_dir), "user_id", "ts", "6 hours")


@register("SELECT event_type, ws AS start, ws + INTERVAL '12' HOUR AS \"end\", count(*) AS n, round(sum(round(value * 100)) / 100, 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL '6' HOUR, ts), time_bucket(INTERVAL '6' HOUR, ts) - INTERVAL '6' HOUR]) AS ws FROM events) GROUP BY 1, 2")
def sliding_totals(spark, sf_dir):
    """Windows of twelve hours every six."""
    cents = F.sum(F.round(F.col("value") * 100))
    return timejoin.sliding(_events(spark, sf_dir), "event_type", "ts", "12 hours", "6 hours", F.count(F.lit(1)).alias("n"), F.round(cents / 100, 2).alias("total"))


_ARRIVED = "SELECT event_id, user_id, ts, event_id * 7919 % 101 AS jitter, epoch_us(ts) // 600000000 AS slot FROM events"


@register(f"SELECT event_id, coalesce(ts < max(ts) OVER (ORDER BY slot, jitter, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '5' MINUTE, false) AS late FROM ({_ARRIVED.replace('600000000', '7200000000')})")
def late_events(spark, sf_dir):
    """Events that arrive, shuffled within two hours, more than five minutes behind the latest before them."""
    own = _events(spark, sf_dir).select("event_id", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 7_200_000_000).cast("long").alias("slot"), (F.col("event_id") * 7919 % 101).alias("jitter"))
    return timejoin.with_late(own, "ts", ["slot", "jitter", "event_id"], "5 MINUTES").select("event_id", "late")


@register()
def latency_sketches(spark, sf_dir):
    """Quantiles and distinct users of each event type over all days, from sketches stored by day."""
    daily = sketches.daily(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["day", "event_type"], "value", "user_id")
    return sketches.merged(daily, ["event_type"], [0.5, 0.9, 0.99])


@register("""WITH RECURSIVE e AS (SELECT conv_id, turn, unnest(CASE WHEN turn = 0 THEN []::BIGINT[] WHEN turn % 3 = 0 THEN [0, turn - 1] ELSE [greatest(0, turn - 1 - turn % 2)] END) AS dep FROM conversations),
 walk AS (SELECT conv_id, turn AS node, 0 AS level FROM conversations WHERE turn = 0 UNION ALL SELECT e.conv_id, e.turn, walk.level + 1 FROM walk JOIN e ON e.conv_id = walk.conv_id AND e.dep = walk.node)
 SELECT conv_id, node, max(level) AS level FROM walk GROUP BY conv_id, node""")
def plan_levels(spark, sf_dir):
    """Levels of the turns of each conversation, as nodes of a plan that depend on turns before them."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("node"))
    needs = F.when(F.col("node") == 0, F.expr("cast(array() AS array<bigint>)")).when(F.col("node") % 3 == 0, F.array(F.lit(0).cast("long"), F.col("node") - 1)).otherwise(F.array(F.greatest(F.lit(0).cast("long"), F.col("node") - 1 - F.col("node") % 2)))
    return dag.level_table(turns, turns.select("conv_id", "node", F.explode(needs).alias("dependency")), "conv_id", 16)


@register()
def link_ranks(spark, sf_dir):
    """The rank of every page and link target in the graph of links."""
    return graph.ranks(graph.links(load(spark, sf_dir, "pages"))).select("node", F.round("rank", 9).alias("rank"))


#: Sentences as lines of drawings: a fence, a border, a line with Chinese text, an indented or an empty one, by their length.
_DRAWN = "SELECT doc_id, string_agg(CASE length(x) % 5 WHEN 0 THEN '```' WHEN 1 THEN repeat(' ', length(x) % 13) || '+' || repeat('-', length(x) % 40 + 3) || '+' WHEN 2 THEN x || '中文' WHEN 3 THEN repeat(' ', length(x) % 20) || x ELSE '' END, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS x, unnest(range(len(string_split(text, '. ')))) AS i FROM documents) GROUP BY doc_id"


@register(f"""WITH d AS ({_DRAWN}), l AS (SELECT doc_id, rtrim(unnest(string_split(text, chr(10))), chr(13)) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
 b AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare, length(line) - length(ltrim(line, ' ')) AS indent FROM l),
 k AS (SELECT *, length(bare) + length(bare) - length(regexp_replace(bare, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS width, CASE WHEN starts_with(bare, '```') THEN 'fence' WHEN bare = '' THEN 'blank' WHEN length(bare) >= 5 AND contains(bare, '+') AND contains(bare, '-') AND NOT contains(bare, '|') AND NOT regexp_matches(bare, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'border' WHEN regexp_matches(bare, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'wide' ELSE 'text' END AS kind FROM b),
 p AS (SELECT *, count(*) FILTER (kind = 'fence') OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM k),
 n AS (SELECT o.doc_id, o.i, any_value(o.width) AS width, max({{'i': q.i, 'kind': q.kind, 'width': q.width}}) AS near FROM p o LEFT JOIN p q ON q.doc_id = o.doc_id AND q.i BETWEEN o.i - 50 AND o.i - 1 AND (q.kind IN ('fence', 'wide') OR q.kind = 'text' AND q.indent > o.indent + 5) WHERE o.kind = 'border' AND o.inside AND o.indent <= 10 GROUP BY o.doc_id, o.i),
 t AS (SELECT doc_id, i, width, CASE WHEN near.kind = 'wide' THEN near.width END AS target FROM n)
 SELECT doc_id, i + 1 AS line_no, width, target, coalesce(width < target - 2, false) AS narrow FROM t""")
def border_targets(spark, sf_dir):
    """Borders in drawings made of each document's sentences, and the widths that they should have."""
    drawn = F.transform(F.split("text", r"\. ", -1), lambda x: F.when(F.length(x) % 5 == 0, "```").when(F.length(x) % 5 == 1, F.concat(F.repeat(F.lit(" "), F.length(x) % 13), F.lit("+"), F.repeat(F.lit("-"), F.length(x) % 40 + 3), F.lit("+"))).when(F.length(x) % 5 == 2, F.concat(x, F.lit("中文"))).when(F.length(x) % 5 == 3, F.concat(F.repeat(F.lit(" "), F.length(x) % 20), x)).otherwise(""))
    return layout.border_targets(load(spark, sf_dir, "documents").select("doc_id", F.array_join(drawn, "\n").alias("text")))
