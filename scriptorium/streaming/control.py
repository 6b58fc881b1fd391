"""Sequential control operators over keyed, ordered events, in batch and as streams.

An operator is a start state and a step ``(state, now, value) -> (state, outputs)``. In batch, events are dealt by ranges of
(key, order), so that a key with very many events is split; the steps run over Arrow batches (operators/scans.py). As a stream, the state of a key lives in the state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import scans
from scriptorium.operators.scans import Machine
from scriptorium.tables import fresh

def _stream(stream: DataFrame, key: str, time: str, order: list[str], value: str, machine: Machine) -> DataFrame:
    schema = stream.select("*", *(F.lit(None).cast(k).alias(n) for n, k in machine.outputs)).schema

    def run(_, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = pickle.loads(store.get[0]) if store.exists else machine.start
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)
        made = []
        for now, v in zip(scans.seconds(rows[time].tolist()), rows[value].tolist(), strict=True):
            state, outputs = machine.step(state, now, v)
            made.append(outputs)
        store.update((pickle.dumps(state),))
        yield rows.assign(**{n: [m[i] for m in made] for i, (n, _) in enumerate(machine.outputs)})

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


# -- the operators -----------------------------------------------------------------------------


def bucket(rate: float = 10.0, burst: float = 20.0) -> Machine:
    """Starts full, gains ``rate`` tokens a second up to ``burst``; an event takes one, if there is one."""

    def step(state, now, _):
        tokens, last = state
        tokens = min(burst, tokens + (now - last) * rate) if last is not None else tokens
        ok = tokens >= 1
        return (tokens - ok, now), (ok,)

    return Machine((burst, None), step, (("allowed", "boolean"),))


def waiting_bucket(rate: float = 10.0, burst: int = 20, timeout: float = 30.0) -> Machine:
    """As ``bucket``, but an event waits for its token, behind those that wait already, unless that takes more than ``timeout`` seconds.

    The state is the time, in whole microseconds, at which the bucket will be full. Outputs: whether the event
    gets its token, and after how many microseconds (null: never).
    """
    gap, patience = round(1e6 / rate), round(timeout * 1e6)

    def step(full, now, _):
        now = round(now * 1e6)
        wait = max(0, full - (burst - 1) * gap - now)
        if wait > patience:
            return full, (False, None)
        return max(full, now) + gap, (True, wait)

    return Machine(-(1 << 62), step, (("granted", "boolean"), ("waited_us", "long")))


def known_keys(most: int = 50_000) -> Machine:
    """Which keys are among the newest ``most`` that were entered; a known key isn't entered again, the oldest one goes first. Empty keys are never known.

    The state is the entered keys in their order, changed in place: each run has its own.
    """

    def step(kept, _, value):
        kept = {} if kept is None else kept
        if value is None or value == "":
            return kept, (False,)
        if value in kept:
            return kept, (True,)
        kept[value] = None
        if len(kept) > most:
            del kept[next(iter(kept))]
        return kept, (False,)

    return Machine(None, step, (("repeated", "boolean"),))


def breaker(threshold: int = 5, recovery: float = 60.0, trials: int = 1) -> Machine:
    """``threshold`` failures in a row open; after ``recovery`` seconds ``trials`` successes in a row close, and one failure opens again. The value is success."""

    def step(state, now, success):
        name, failures, opened, passed = state
        if name == "open" and now - opened >= recovery:
            name, passed = "half_open", 0
        admitted = name != "open"
        if admitted and success:
            passed += name == "half_open"
            if name == "closed" or passed >= trials:
                name, failures = "closed", 0
        elif admitted:
            failures += 1
            if name == "half_open" or failures >= threshold:
                name, opened = "open", now
        return (name, failures, opened, passed), (name, admitted)

    return Machine(("closed", 0, 0.0, 0), step, (("state", "string"), ("admitted", "boolean")))


def provider(failures: int = 3, cooldown: float = 60.0) -> Machine:
    """Unhealthy after ``failures`` in a row: calls are refused until ``cooldown`` seconds have passed, then tried again. The value is success."""

    def step(state, now, success):
        failed, since = state
        admitted = failed < failures or now - since >= cooldown
        if admitted:
            failed, since = (0, 0.0) if success else (failed + 1, now)
        return (failed, since), (admitted, failed < failures)

    return Machine((0, 0.0), step, (("admitted", "boolean"), ("healthy", "boolean")))


def lru(capacity: int, ttl: float) -> Machine:
    """A cache of ``capacity`` values, least recently used out first; older than ``ttl`` seconds misses (0: never; below 0: nothing is kept)."""

    def step(cache, now, value):
        inserted = dict(cache)
        hit = value in inserted and not (ttl > 0 and now - inserted[value] > ttl)
        kept = tuple(x for x in cache if x[0] != value)
        if ttl < 0:
            return (), (False,)
        if not hit:
            kept = kept[max(0, len(kept) - capacity + 1) :]
        return (*kept, (value, inserted[value] if hit else now)), (hit,)

    return Machine((), step, (("hit", "boolean"),))


def token_bucket(events: DataFrame, key: str, time: str, order: list[str], rate: float = 10.0, burst: float = 20.0) -> DataFrame:
    """``events`` with allowed. A null key is a key."""
    return scans.replay(events, key, time, order, key, bucket(rate, burst))


def waiting_tokens(events: DataFrame, key: str, time: str, order: list[str], rate: float = 10.0, burst: int = 20, timeout: float = 30.0) -> DataFrame:
    """``events`` with granted and waited_us: a token each, first come first served, within ``timeout`` seconds."""
    return scans.replay(events, key, time, order, key, waiting_bucket(rate, burst, timeout))


def repeated_keys(events: DataFrame, partition: str, key: str, time: str, order: list[str], most: int = 50_000) -> DataFrame:
    """``events`` with repeated: whether ``key`` was known to the table of ``partition``, which keeps the newest ``most`` keys."""
    return scans.replay(events, partition, time, order, key, known_keys(most))


def circuit_breaker(events: DataFrame, key: str, time: str, order: list[str], success: str, threshold: int = 5, recovery: float = 60.0, trials: int = 1) -> DataFrame:
    """``events`` with state (after the event) and admitted."""
    return scans.replay(events, key, time, order, success, breaker(threshold, recovery, trials))


def provider_calls(calls: DataFrame, key: str, time: str, order: list[str], success: str, failures: int = 3, cooldown: float = 60.0) -> DataFrame:
    """``calls`` with admitted and healthy (after the call)."""
    return scans.replay(calls, key, time, order, success, provider(failures, cooldown))


def lru_hits(requests: DataFrame, partition: str, key: str, time: str, order: list[str], capacity: int, ttl: float) -> DataFrame:
    """``requests`` with hit: a cache for each ``partition`` that keeps ``capacity`` of the values of ``key``."""
    return scans.replay(requests, partition, time, order, key, lru(capacity, ttl))


def stream_control(stream: DataFrame, key: str, time: str, order: list[str], value: str, machine: Machine) -> DataFrame:
    """A machine over a stream: events of a micro-batch in ``order``, the state of each key kept between batches and restarts."""
    return _stream(stream, key, time, order, value, machine)


def provider_health(calls: DataFrame, key: str, order: list[str], success: str, failures: int = 3) -> DataFrame:
    """``calls`` with healthy (after the call): false once ``failures`` calls in a row failed, true again after a success.

    Only windows: the run of failures is counted since the last success, so no key's history is gathered in Python.
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = calls.withColumn("_run", F.sum(F.col(success).cast("long")).over(so_far))
    since = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("healthy", F.sum((~F.col(success)).cast("long")).over(since) < failures).drop("_run")


# -- dedup -------------------------------------------------------------------------------------


def first_of_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Idempotent dedup in batch: the first event of each key; events with an empty key all stay, each a group of its own. One pass; the limit runs before the shuffle."""
    place, own = fresh(events, "place", "own")
    empty = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    dealt = events.withColumn(own, F.when(empty, F.monotonically_increasing_id()))
    return dealt.withColumn(place, F.row_number().over(Window.partitionBy(key, own).orderBy(*order))).filter(F.col(place) == 1).drop(place, own)


def stream_first_of_key(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The same over a stream; state of keys older than the watermark goes."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
