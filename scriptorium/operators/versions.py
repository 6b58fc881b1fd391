"""Versions and backups of files, checks before a write. A file may hold a third of all rows: its rows are numbered by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import scans
from scriptorium.tables import fresh, newest

# What a write may do to a file's size and lines, and how long backups and versions stay.
AGENT_RATIOS = (0.5, 5.0)
SCRIPT_RATIOS, SCRIPT_LINES = (0.5, 10.0), 0.7
TTL_DAYS, NEWEST, ALL_DAYS, LATEST_DAYS, KEPT_VERSIONS = 7, 20, 30, 90, 50


def numbered(rows: DataFrame, key: str, order: str, name: str = "number") -> DataFrame:
    """``rows`` with their places (from 1) within ``key`` by ``order``.

    Every row has a place: rows without ``order`` come last within their key, rows of equal ``order`` one after the other in
    any order; a null key is a key. A key with very many rows is split, whatever its orders are.
    """
    (one,) = fresh(rows, "one")
    own = scans.running(rows.withColumn(one, F.lit(1)), key, [F.col(order).asc_nulls_last()], one, name)
    return own.withColumn(name, F.col(name) + 1).drop(one)


def with_digests(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with digest, size in bytes and number of lines in place of ``text``: what later steps shuffle is small."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return texts.select(*(c for c in texts.columns if c != text), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("size"), lines.cast("long").alias("n_lines"))


def committed(texts: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """A version for each row of ``texts``: number from 1 by ``order`` within a file, digest, size, number of lines."""
    return numbered(with_digests(texts, text), file, order, "version")


def pruned(versions: DataFrame, file: str, version: str = "version", most: int = KEPT_VERSIONS) -> DataFrame:
    """The newest ``most`` versions of each file; the limit runs before the shuffle."""
    return newest(versions, [file], [F.col(version).desc()], most)


def stored(versions: DataFrame, file: str) -> DataFrame:
    """(files, versions, total_bytes)."""
    return versions.agg(F.count_distinct(file).alias("files"), F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def fresh_backups(backups: DataFrame, file: str, age: str, order: list[Column], days: int = TTL_DAYS, most: int = NEWEST) -> DataFrame:
    """Backups not older than ``days`` and among the newest ``most`` of their file."""
    return newest(backups, [file], order, most).filter(F.col(age) <= days)


def tiered_backups(backups: DataFrame, file: str, age: str, order: list[Column], all_days: int = ALL_DAYS, latest_days: int = LATEST_DAYS) -> DataFrame:
    """All backups of ``all_days``; of older ones up to ``latest_days`` the latest of each file; none beyond."""
    recent = backups.filter(F.col(age) <= all_days)
    old = backups.filter((F.col(age) > all_days) & (F.col(age) <= latest_days))
    return recent.unionByName(newest(old, [file], order, 1))


def with_previous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with previous: ``value`` of the row before within ``key`` by ``order``, as ``numbered`` places them; null for the first."""
    place, of, behind = fresh(rows, "place", "of", "behind")
    own = numbered(rows, key, order, place)
    last = own.select(F.col(key).alias(of), (F.col(place) + 1).alias(behind), F.col(value).alias("previous"))
    return own.join(last, F.col(key).eqNullSafe(F.col(of)) & (F.col(place) == F.col(behind)), "left").select(*rows.columns, "previous")


def write_level(size: Column, previous: Column, ratios: tuple[float, float] = AGENT_RATIOS) -> Column:
    """``P0`` for an empty text, ``P1`` for one that shrinks or grows beyond ``ratios``, else ``ok``; an empty or missing file before counts as new."""
    least, most = ratios
    far = (previous > 0) & ((size < least * previous) | (size > most * previous))
    return F.when(size == 0, "P0").when(F.coalesce(far, F.lit(False)), "P1").otherwise("ok")


def script_level(size: Column, previous: Column, lines: Column, previous_lines: Column) -> Column:
    """As write_level with wider limits, and ``P1`` too for less than 0.7 of the lines."""
    fewer = F.coalesce((previous_lines > 0) & (lines < SCRIPT_LINES * previous_lines), F.lit(False))
    level = write_level(size, previous, SCRIPT_RATIOS)
    return F.when((level == "ok") & fewer, "P1").otherwise(level)
