"""Lockfiles of pipelines: versions and configuration digests of agents, and what differs from them later. Driver code."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any


def config_hash(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def lock(pipeline: str, agents: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """``agents``: version, dependencies, pool_size and config by name."""
    kept = {name: {"version": a["version"], "dependencies": list(a.get("dependencies", ())), "pool_size": a.get("pool_size", 1), "config_hash": config_hash(a.get("config", {}))} for name, a in agents.items()}
    return {"pipeline": pipeline, "node_count": len(kept), "agents": kept}


def write(path: str | Path, locked: Mapping[str, Any]) -> None:
    """JSON, which YAML readers read too; replaced as a whole."""
    target = Path(path)
    fresh = target.with_name(target.name + ".new")
    fresh.write_text(json.dumps(locked, ensure_ascii=False, indent=2), encoding="utf-8")
    fresh.replace(target)


def differences(locked: Mapping[str, Any] | None, pipeline: str, agents: Mapping[str, Mapping[str, Any]]) -> list[tuple[str, str]]:
    """(agent, what): ``missing lockfile``, ``pipeline``, ``not locked`` or ``version``; an empty list if all agree."""
    if locked is None:
        return [("", "missing lockfile")]
    out = [("", "pipeline")] if locked.get("pipeline") != pipeline else []
    known = locked.get("agents", {})
    return out + [(name, "version" if known.get(name) else "not locked") for name, a in agents.items() if not known.get(name) or known[name]["version"] != a["version"]]
