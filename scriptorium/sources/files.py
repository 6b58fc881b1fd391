"""Reading texts, JSON lines, settings and YAML."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.values import literal, merged
from scriptorium.operators.search import queries_of

try:
    import yaml
except ImportError:
    yaml = None


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file below ``path`` as one row; bytes that aren't UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def queries(spark: SparkSession, path: str, default: str) -> DataFrame:
    """(path, pos, query): the queries of each file below ``path``, one a line; ``default`` for a file without any."""
    lines = documents(spark, path).select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return queries_of(lines, "path", "line", default)


def log_rows(spark: SparkSession, path: str, schema: str, most: int, since: Column | None = None, **equal: str | None) -> DataFrame:
    """The newest ``most`` rows (column ts) of JSON line files below ``path`` that match (a top-k report); broken lines are left out."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED", recursiveFileLookup=True)
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value) if value is not None else rows
    return (rows.filter(F.col("ts") >= since) if since is not None else rows).orderBy(F.desc("ts")).limit(most)


def parse_yaml(text: str) -> Any:
    """A YAML document; JSON alone where no YAML parser is installed."""
    return yaml.safe_load(text) if yaml else json.loads(text)


def read_yaml(path: str | Path, default: Any = None) -> Any:
    """A YAML file, or ``default`` where there is none."""
    path = Path(path)
    return parse_yaml(path.read_text("utf-8")) if path.exists() else default


def find_profile(name: str, folders: list[str | Path], default: Mapping[str, Any]) -> Mapping[str, Any]:
    """A profile by its path or its name in the first folder that has it, laid over ``default``."""
    for path in (Path(name), *(Path(f) / f"{name}.yaml" for f in folders)):
        if path.is_file():
            return merged(default, read_yaml(path) or {})
    return default


def parse_env(text: str) -> dict[str, str]:
    """``NAME=value`` lines; comments and other lines are left out, quotes around a value too."""
    out = {}
    for line in text.splitlines():
        name, mark, value = line.strip().partition("=")
        if mark and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out


def settings(folder: str | Path, names: str = ".env", environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings of the nearest file ``names`` in ``folder`` or above; what the environment has set wins."""
    environment = os.environ if environment is None else environment
    found: dict[str, str] = {}
    for place in (Path(folder).resolve(), *Path(folder).resolve().parents):
        if (place / names).is_file():
            found = parse_env((place / names).read_text("utf-8"))
            break
    return {k: literal(environment.get(k) or v) for k, v in found.items()}
