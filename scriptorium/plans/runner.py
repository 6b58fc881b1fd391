"""Running plans: stages by level with retries, breakers, saved results, hooks and an audit trail. Driver code around DataFrames."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.planner import Plan, Step
from scriptorium.sources.writes import load_state, save_state
from scriptorium.streaming import control


class Stage(Protocol):
    """A user's stage. Optional methods: on_start(), on_stop(), on_pause(), on_resume(), on_config(settings), snapshot() and restore(state)."""

    def run(self, spark: SparkSession, inputs: dict[str, DataFrame], settings: Mapping[str, Any]) -> DataFrame: ...


class TextTransform(Protocol):
    """A user's rewrite of a text column, as a model would give it; null leaves a text as it is."""

    def __call__(self, text: Column) -> Column: ...


def identity(text: Column) -> Column:
    return text


@dataclass
class Registry:
    """Stages by agent name. ``respawn``: how often a stage that fails is made anew by its factory."""

    factories: dict[str, Callable[[], Stage]] = field(default_factory=dict)
    respawn: int = 3
    live: dict[str, Stage] = field(default_factory=dict)
    respawned: dict[str, int] = field(default_factory=dict)

    def register(self, name: str, factory: Callable[[], Stage]) -> None:
        self.factories[name] = factory

    def get(self, name: str) -> Stage:
        if name not in self.live:
            self.live[name] = self.factories[name]()
            call(self.live[name], "on_start")
        return self.live[name]

    def failed(self, name: str) -> bool:
        """Drop a stage that failed; whether it may be made anew. Its snapshot, if it has one, is restored."""
        old = self.live.pop(name, None)
        if self.respawned.get(name, 0) >= self.respawn:
            return False
        self.respawned[name] = self.respawned.get(name, 0) + 1
        state = call(old, "snapshot") if old else None
        if state is not None:
            call(self.get(name), "restore", state)
        return True


def call(stage: Any, method: str, *args: Any) -> Any:
    return getattr(stage, method)(*args) if hasattr(stage, method) else None


def delay(strategy: str, base: float, attempt: int, jitter: float = 0.0) -> float:
    """Seconds before an attempt (from 1): the driver's twin of monitor.backoff."""
    plain = {"linear": base * attempt, "fixed": base}.get(strategy, base * 2 ** (attempt - 1))
    return max(0.1, min(120.0, plain) * (1 + random.uniform(-jitter, jitter)))


class Cancelled(Exception):
    """The run was cancelled."""


@dataclass
class Run:
    """A run of a plan. With ``folder``, a shared one, every result is a Parquet table there, and a further run takes up what is done."""

    spark: SparkSession
    plan: Plan
    registry: Registry
    folder: str | None = None
    listeners: dict[str, Callable[[str, dict], None]] = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep
    workers: int = 4
    audit: list[dict[str, Any]] = field(default_factory=list)
    results: dict[str, DataFrame] = field(default_factory=dict)
    _go: threading.Event = field(default_factory=threading.Event)
    _stop: threading.Event = field(default_factory=threading.Event)
    _breakers: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._go.set()

    # -- control -------------------------------------------------------------------------------

    def pause(self) -> None:
        """No further stage starts; running ones end."""
        self._go.clear()
        self._tell("run.paused", {})
        for stage in self.registry.live.values():
            call(stage, "on_pause")

    def resume(self) -> None:
        for stage in self.registry.live.values():
            call(stage, "on_resume")
        self._tell("run.resumed", {})
        self._go.set()

    def cancel(self) -> None:
        """Running Spark jobs of this run are cancelled, no further stage starts."""
        self._stop.set()
        self._go.set()
        self.spark.sparkContext.cancelJobsWithTag(f"run-{id(self)}")

    def rollback(self, name: str) -> list[str]:
        """Forget the results of a stage and of all that depend on it; their names."""
        gone, more = {name}, True
        while more:
            more = {s.name for s in self.plan.steps if set(s.dependencies) & gone} - gone
            gone |= more
        for x in gone:
            self.results.pop(x, None)
        state = self._state()
        self._save({k: v for k, v in state.items() if k not in gone})
        self._tell("run.rolled_back", {"stages": sorted(gone)})
        return sorted(gone)

    # -- running -------------------------------------------------------------------------------

    def execute(self) -> dict[str, str]:
        """Status by stage: ``ok``, ``failed``, ``skipped`` (a dependency failed) or ``saved`` (taken up). With fail_fast a failure ends the run after its level."""
        status: dict[str, str] = {}
        done = self._state()
        for level in self.plan.levels:
            self._go.wait()
            if self._stop.is_set():
                raise Cancelled(self.plan.name)
            todo = []
            for name in level:
                if name in self.results or name in done:
                    if name not in self.results:
                        self.results[name] = self.spark.read.parquet(done[name])
                    status[name] = "saved"
                elif any(status.get(d) in ("failed", "skipped") for d in self.plan.step(name).dependencies):
                    status[name] = "skipped"
                else:
                    todo.append(name)
            with ThreadPoolExecutor(max_workers=max(1, min(self.workers, len(todo) or 1))) as pool:
                for name, said in zip(todo, pool.map(self._attempts, todo), strict=True):
                    status[name] = said
            self._tell("level.done", {"stages": level, "progress": int(100 * len(status) / len(self.plan.steps))})
            if self.plan.fail_fast and "failed" in status.values():
                break
        return status

    def _attempts(self, name: str) -> str:
        step = self.plan.step(name)
        retry, breaker = step.settings.get("retry", {}), step.settings.get("circuit_breaker", {})
        machine = control.breaker(breaker.get("threshold", 5), breaker.get("recovery", 60))
        self.spark.addTag(f"run-{id(self)}")
        for attempt in range(1, int(retry.get("attempts", 1)) + 1):
            state = self._breakers.get(step.agent, machine.start)
            if breaker.get("enabled") and state[0] == "open" and time.time() - state[2] < breaker.get("recovery", 60):
                self._tell("stage.refused", {"stage": name})
                return "failed"
            try:
                self.results[name] = self._once(step)
                good = True
            except Exception as problem:
                good = False
                self._tell("stage.failed", {"stage": name, "attempt": attempt, "error": f"{type(problem).__name__}: {problem}"[:300]})
            self._breakers[step.agent], _ = machine.step(state, time.time(), good)
            if good:
                self._tell("stage.done", {"stage": name, "attempt": attempt})
                return "ok"
            if not self.registry.failed(step.agent):
                break
            if attempt < int(retry.get("attempts", 1)):
                self.sleep(delay(retry.get("strategy", "exponential"), retry.get("base", 1.0), attempt, retry.get("jitter", 0.0)))
        return "failed"

    def _once(self, step: Step) -> DataFrame:
        stage = self.registry.get(step.agent)
        call(stage, "on_config", step.settings)
        inputs = {d: self.results[d] for d in step.dependencies}
        made = stage.run(self.spark, inputs, step.settings)
        if self.folder is None:
            return made
        path = f"{self.folder.rstrip('/')}/{step.name}-{time.time_ns()}"
        made.write.parquet(path)
        self._save(self._state() | {step.name: path})
        return self.spark.read.schema(made.schema).parquet(path)

    # -- state ---------------------------------------------------------------------------------

    def _state(self) -> dict[str, str]:
        return (load_state(f"{self.folder}/state.json") or {}) if self.folder else {}

    def _save(self, state: dict[str, str]) -> None:
        if self.folder:
            with _STATE_LOCK:
                save_state(f"{self.folder}/state.json", state)

    def _tell(self, event: str, payload: dict[str, Any]) -> None:
        self.audit.append({"at": time.time(), "event": event, "payload": json.dumps(payload, ensure_ascii=False, sort_keys=True)})
        for pattern, listener in self.listeners.items():
            if pattern in ("*", event) or pattern.endswith(".*") and event.startswith(pattern[:-1]):
                listener(event, payload)

    def audit_table(self) -> DataFrame:
        """(at, event, payload) of what happened so far."""
        return self.spark.createDataFrame([(a["at"], a["event"], a["payload"]) for a in self.audit], "at double, event string, payload string")

    def report(self) -> dict[str, Any]:
        """Counts of events, and the stages with results."""
        counts: dict[str, int] = {}
        for a in self.audit:
            counts[a["event"]] = counts.get(a["event"], 0) + 1
        return {"plan": self.plan.name, "events": counts, "results": sorted(self.results)}


_STATE_LOCK = threading.RLock()


def submit_many(runs: list[Run], at_once: int = 2) -> list[dict[str, str] | str]:
    """Statuses of several runs, ``at_once`` at a time in the order given; the message of one that raised."""

    def one(run: Run) -> dict[str, str] | str:
        try:
            return run.execute()
        except Exception as problem:
            return f"{type(problem).__name__}: {problem}"

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(one, runs))


def resolve_content(results: Mapping[str, DataFrame], order: tuple[str, ...] = ("layout", "quality_gate", "writer")) -> DataFrame | None:
    """The result of the first stage in ``order`` that has one: the latest state of a document."""
    for name in order:
        for stage, result in results.items():
            if stage.split("_pool_")[0] == name and result is not None:
                return result
    return None


def merged_pool(results: Mapping[str, DataFrame], name: str) -> DataFrame | None:
    """Rows of all instances of a pool, one behind the other."""
    own = [r for n, r in sorted(results.items()) if n.split("_pool_")[0] == name]
    out = None
    for r in own:
        out = r if out is None else out.unionByName(r)
    return out


def of_shard(rows: DataFrame, order: str, settings: Mapping[str, Any]) -> DataFrame:
    """The rows of a pool's instance: every n-th by a number column."""
    return rows.filter(F.pmod(F.col(order), F.lit(int(settings.get("instances", 1)))) == int(settings.get("instance", 0)))
