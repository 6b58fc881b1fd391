"""Sinks: safe writes of single files, state files with checksums, article tables, logs, hooks."""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scriptorium.operators import monitor, versions
from scriptorium.operators.writer import safe_name


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def replace_file(path: str | Path, data: bytes) -> None:
    """Write a file as a whole: readers see the old or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_name(path.name + ".new")
    fresh.write_bytes(data)
    os.replace(fresh, path)


@dataclass
class SafeWriter:
    """Writes texts after a check against what they replace, with backups, a manifest and versions in ``folder``.

    ratios, lines: least and most of the old size, least share of the old lines. days, newest: how long and how
    many backups stay. newline: ``lf``, ``crlf`` or ``auto``. dry_run: check and preview only.
    """

    folder: str | Path
    ratios: tuple[float, float] = versions.AGENT_RATIOS
    lines: float = 0.0
    days: int = versions.TTL_DAYS
    newest: int = versions.NEWEST
    newline: str = "auto"
    dry_run: bool = False
    clock: Callable[[], float] = field(default=time.time)

    def level(self, new: str, old: str | None) -> str:
        """``P0`` for an empty text, ``P1`` for one too small, too large or with too few lines, else ``ok``."""
        if not new.strip():
            return "P0"
        if not old:
            return "ok"
        least, most = self.ratios
        far = not least * len(old) <= len(new) <= most * len(old)
        return "P1" if far or new.count("\n") + 1 < self.lines * (old.count("\n") + 1) else "ok"

    def preview(self, new: str, old: str | None) -> str:
        return "\n".join(difflib.unified_diff((old or "").splitlines(), new.splitlines(), "old", "new", lineterm=""))

    def write(self, name: str, text: str) -> dict[str, Any]:
        """(level, written, backup, version, diff). Nothing is written unless the level is ``ok``."""
        target = Path(self.folder) / name
        if self.newline != "auto":
            text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "\r\n" if self.newline == "crlf" else "\n")
        coding = "utf-8-sig" if target.suffix in (".csv", ".tsv") else "utf-8"
        old = target.read_bytes().decode(coding, "replace") if target.exists() else None
        out = {"level": self.level(text, old), "written": False, "backup": None, "version": None, "diff": self.preview(text, old)}
        if out["level"] != "ok" or self.dry_run:
            return out
        if old is not None:
            out["backup"] = self._backup(target)
        data = text.encode(coding)
        replace_file(target, data)
        out["version"], out["written"] = self._note(name, data, text), True
        return out

    def _backup(self, target: Path) -> str:
        place = Path(self.folder) / ".backups"
        place.mkdir(exist_ok=True)
        copy = place / f"{target.name}.{int(self.clock() * 1e6)}"
        shutil.copy2(target, copy)
        kept = sorted(place.glob(f"{target.name}.*"), key=lambda p: int(p.suffix[1:]), reverse=True)
        for at, path in enumerate(kept):
            if at >= self.newest or self.clock() - int(path.suffix[1:]) / 1e6 > self.days * 86400:
                path.unlink()
        return str(copy)

    def _note(self, name: str, data: bytes, text: str) -> int:
        state = load_state(Path(self.folder) / ".manifest.json") or {}
        history = state.get(name, [])
        version = history[-1]["version"] + 1 if history else 1
        history = [*history, {"version": version, "digest": digest(data), "size": len(data), "n_lines": text.count("\n") + 1}]
        save_state(Path(self.folder) / ".manifest.json", state | {name: history[-versions.KEPT_VERSIONS :]})
        return version


def save_state(path: str | Path, state: Mapping[str, Any]) -> None:
    """A JSON state with its checksum; the state before stays beside it."""
    path = Path(path)
    body = json.dumps(state, ensure_ascii=False, sort_keys=True)
    if path.exists():
        replace_file(path.with_name(path.name + ".bak"), path.read_bytes())
    replace_file(path, json.dumps({"checksum": digest(body.encode()), "state": state}, ensure_ascii=False, sort_keys=True).encode())


def load_state(path: str | Path) -> dict[str, Any] | None:
    """The state, or the one before it where the checksum is wrong; None without either."""
    for place in (Path(path), Path(str(path) + ".bak")):
        try:
            held = json.loads(place.read_text("utf-8"))
            if held["checksum"] == digest(json.dumps(held["state"], ensure_ascii=False, sort_keys=True).encode()):
                return held["state"]
        except (OSError, ValueError, KeyError):
            pass
    return None


def expired(paths: Iterable[str | Path], days: float, now: float | None = None) -> list[Path]:
    """Files older than ``days``."""
    now = time.time() if now is None else now
    return [p for p in map(Path, paths) if now - p.stat().st_mtime > days * 86400]


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles (task, title, url, text) by task: file, heading lines and text. Parquet, a folder a task."""
    head = F.concat(F.lit("# "), "title", F.lit("\n\n> "), "url", F.lit("\n\n"))
    own = articles.select("task", safe_name(F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))).alias("file"), F.concat(F.coalesce(head, F.lit("")), "text").alias("content"))
    own.write.mode("overwrite").partitionBy("task").parquet(path)


def write_log(stream: DataFrame, path: str, checkpoint: str, time_column: str = "ts"):
    """A stream of log rows as JSON lines, a folder a day; exactly once, over restarts."""
    own = stream.withColumn("day", F.to_date(time_column))
    return own.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_hooks(stream: DataFrame, hooks: Mapping[str, Callable[[list[dict]], None]], event: str, checkpoint: str, most: int = 10_000):
    """Each micro-batch's events to the senders whose patterns match, ``most`` at once. Senders run on the executors, once or more a task, so they must pickle."""

    def sending(sender: Callable[[list[dict]], None]):
        def send(rows: Iterable[Row]) -> None:
            rows = iter(rows)
            while part := [r.asDict() for r in islice(rows, most)]:
                sender(part)

        return send

    def send(batch: DataFrame, _: int) -> None:
        for pattern, sender in hooks.items():
            batch.filter(monitor.hook_matches(F.col(event), F.lit(pattern))).foreachPartition(sending(sender))

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
