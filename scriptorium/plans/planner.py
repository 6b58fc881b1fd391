"""Plans out of YAML or mappings: defaults, pools, checks, order, preview. Runs on the driver: a plan has a few nodes."""

from __future__ import annotations

import ast
import heapq
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from scriptorium.functions.values import merged
from scriptorium.plans.dag import Node, levels

# What a node has where nothing else is said, costs by words of a node's name, and calls that no plug-in may make.
NODE_DEFAULTS: dict[str, Any] = {"timeout": 120, "retry": {"attempts": 3, "strategy": "exponential", "base": 1.0}, "circuit_breaker": {"enabled": False, "threshold": 5, "recovery": 60}, "priority": 100, "pool_size": 1}
HEAVY, LIGHT = ("render", "transform", "parse", "compute"), ("fetch", "search", "download", "request")
DENIED = ("os.system", "os.popen", "os.exec", "os.remove", "os.rmdir", "os.unlink", "subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_output", "shutil.rmtree", "eval", "exec", "compile", "__import__")
KINDS = {"int": int, "float": (int, float), "str": str, "bool": bool, "list": list, "dict": dict}


@dataclass(frozen=True)
class Step:
    """A node of a plan with its settings."""

    name: str
    agent: str
    dependencies: tuple[str, ...] = ()
    settings: dict[str, Any] = field(default_factory=dict)

    @property
    def priority(self) -> int:
        return int(self.settings.get("priority", 100))


@dataclass(frozen=True)
class Plan:
    name: str
    steps: tuple[Step, ...]
    fail_fast: bool = True

    @property
    def levels(self) -> list[list[str]]:
        return levels([Node(s.name, s.dependencies) for s in self.steps])

    def step(self, name: str) -> Step:
        return next(s for s in self.steps if s.name == name)


def build(spec: Mapping[str, Any], over: Mapping[str, Any] | None = None) -> Plan:
    """A plan of ``{pipeline: {name, fail_fast, retry, circuit_breaker, defaults}, nodes: [{name, agent, dependencies, ...}]}``.

    A node's own settings win over ``defaults``, these over the pipeline's blocks, these over NODE_DEFAULTS; ``over`` (by node
    name) wins over all. A pool becomes ``name_pool_i`` for each instance, and who depends on it depends on all. Unknown
    dependencies, a level that a dependency doesn't come before, and cycles raise ValueError.
    """
    pipeline = dict(spec.get("pipeline") or {})
    base = merged(NODE_DEFAULTS, {k: pipeline[k] for k in ("retry", "circuit_breaker", "timeout") if k in pipeline})
    base = merged(base, pipeline.get("defaults") or {})
    raw = [merged(merged(base, node), (over or {}).get(node["name"], {})) for node in spec.get("nodes", [])]
    check_levels(raw)
    names = {n["name"]: [f"{n['name']}_pool_{i}" for i in range(n["pool_size"])] if n["pool_size"] > 1 else [n["name"]] for n in raw}
    steps = tuple(
        Step(name, n.get("agent", n["name"]), tuple(x for d in n.get("dependencies") or () for x in names.get(d, [d])), {k: v for k, v in n.items() if k not in ("name", "agent", "dependencies")} | {"instance": i, "instances": len(names[n["name"]])})
        for n in raw
        for i, name in enumerate(names[n["name"]])
    )
    plan = Plan(str(pipeline.get("name", "pipeline")), steps, bool(pipeline.get("fail_fast", True)))
    plan.levels  # noqa: B018  raises for cycles and unknown dependencies
    return plan


def check_levels(nodes: Iterable[Mapping[str, Any]]) -> None:
    """ValueError where a node's stated level isn't behind those of its dependencies."""
    stated = {n["name"]: n["level"] for n in nodes if "level" in n}
    for n in nodes:
        for d in n.get("dependencies") or ():
            if n["name"] in stated and stated.get(d, stated[n["name"]] - 1) >= stated[n["name"]]:
                raise ValueError(f"{n['name']} stands on level {stated[n['name']]}, its dependency {d} on {stated[d]}")


def check_settings(settings: Mapping[str, Any], schema: Mapping[str, str]) -> list[str]:
    """Settings whose values aren't of the kind that ``schema`` names; a bool is no int."""
    return [k for k, kind in schema.items() if k in settings and (not isinstance(settings[k], KINDS[kind]) or isinstance(settings[k], bool) and kind in ("int", "float"))]


def ordered(plan: Plan) -> list[str]:
    """Names, each behind its dependencies; among those that could come next the smallest priority number, then name."""
    waiting = {s.name: set(s.dependencies) for s in plan.steps}
    ready = [(s.priority, s.name) for s in plan.steps if not s.dependencies]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        _, name = heapq.heappop(ready)
        out.append(name)
        for s in plan.steps:
            if name in waiting[s.name]:
                waiting[s.name].discard(name)
                if not waiting[s.name]:
                    heapq.heappush(ready, (s.priority, s.name))
    return out


def preview(plan: Plan) -> str:
    """The plan as text: its levels, and each node's dependencies, pool, timeout and retries."""
    out = [f"Plan {plan.name}: {len(plan.steps)} nodes, {len(plan.levels)} levels"]
    for i, level in enumerate(plan.levels):
        out.append(f"Level {i}:")
        for name in level:
            s = plan.step(name)
            out.append(f"  {name} <- {', '.join(s.dependencies) or '-'} (pool {s.settings.get('instances', 1)}, timeout {s.settings.get('timeout')} s, {s.settings.get('retry', {}).get('attempts')} attempts)")
    return "\n".join(out)


def estimate(name: str) -> float:
    """Seconds that a node may take, by words of its name."""
    low = name.lower()
    return 1.0 if any(w in low for w in HEAVY) else 0.01 if any(w in low for w in LIGHT) else 0.1


def executor_for(name: str, threshold: float = 0.5) -> str:
    return "process" if estimate(name) >= threshold else "thread"


def dependency_mismatches(plan: Plan, stated: Mapping[str, Iterable[str]]) -> list[str]:
    """Agents whose own list of dependencies differs from the plan's, in any order; pools count as their node."""
    base = lambda names: sorted({n.split("_pool_")[0] for n in names})
    planned: dict[str, set[str]] = {}
    for s in plan.steps:
        planned.setdefault(s.agent, set()).update(s.dependencies)
    return sorted(a for a, names in stated.items() if a in planned and base(names) != base(planned[a]))


def unsafe_calls(source: str) -> list[str]:
    """Calls in Python source that a plug-in may not make; ``syntax`` where it can't be read."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return ["syntax"]

    def chain(node: ast.expr) -> str:
        return f"{chain(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""

    return sorted({name for n in ast.walk(tree) if isinstance(n, ast.Call) and (name := chain(n.func)) in DENIED})


def narrowed(plan: Plan, only: Iterable[str]) -> Plan:
    """The plan of ``only`` and all that these depend on."""
    keep, todo = set(), list(only)
    while todo:
        name = todo.pop()
        if name not in keep:
            keep.add(name)
            todo += plan.step(name).dependencies
    return replace(plan, steps=tuple(s for s in plan.steps if s.name in keep))
