"""Keyed tables on Parquet: appended versions of rows, of which the latest of each key counts. Upserts rewrite nothing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """Rows by key in a folder that all executors reach. An upsert appends, so a lost write leaves the table as it was."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str]) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _log(self) -> DataFrame:
        versioned = StructType([*self.schema.fields]).add("_version", "long").add("_insert", "boolean")
        try:
            return self.spark.read.schema(versioned).parquet(self.path)
        except Exception as problem:
            if "PATH_NOT_FOUND" in str(problem):
                return self.spark.createDataFrame([], versioned)
            raise

    def _append(self, rows: DataFrame, insert: bool) -> None:
        rows.select(*self.schema.names).withColumn("_version", F.lit(time.time_ns())).withColumn("_insert", F.lit(insert)).write.mode("append").parquet(self.path)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their keys. Of one call's rows with one key, any."""
        self._append(rows, False)

    def insert(self, rows: DataFrame) -> None:
        """Rows count only where their key has none."""
        self._append(rows, True)

    def rows(self) -> DataFrame:
        """The row of each key: the last that was upserted, or else the first that was inserted. Map-side aggregation only."""
        names = [n for n in self.schema.names if n not in self.key]
        log = self._log()
        order = F.struct((~F.col("_insert")).alias("written"), F.when(F.col("_insert"), -F.col("_version")).otherwise(F.col("_version")).alias("at"))
        last = log.groupBy(*self.key).agg(F.max_by(F.struct(*names), order).alias("_row"))
        return last.select(*self.key, "_row.*").select(*self.schema.names)

    def lookup(self, **key: object) -> DataFrame:
        """The row of a key; the filter reaches the files."""
        own = KeyedTable(self.spark, self.path, self.schema, self.key)
        log = self._log
        own._log = lambda: log().filter(" AND ".join(f"{k} = {v!r}" for k, v in key.items()))  # type: ignore[method-assign]
        return own.rows()

    def compact(self, path: str) -> "KeyedTable":
        """A copy with one row a key, written whole to another folder."""
        out = KeyedTable(self.spark, path, self.schema, self.key)
        out.upsert(self.rows())
        return out


class TableCache:
    """Results by the digest of their key, as Parquet tables; ``ttl`` in seconds, 0 for ever, below 0 none."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 3600.0, clock=time.time) -> None:
        self.spark, self.folder, self.ttl, self.clock = spark, folder.rstrip("/"), ttl, clock
        self.hits = self.misses = 0

    def get(self, key: str, make) -> DataFrame:
        """The table of ``key``; made and written first where there is none or it is too old."""
        import hashlib

        base = f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"
        files = self.spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/t-*")) or []
        times = sorted(float(s.getPath().getName()[2:]) for s in kept)
        if times and self.ttl >= 0 and (self.ttl == 0 or self.clock() - times[-1] <= self.ttl):
            self.hits += 1
            return self.spark.read.parquet(f"{base}/t-{times[-1]}")
        self.misses += 1
        made = make()
        if self.ttl < 0:
            return made
        path = f"{base}/t-{float(self.clock())}"
        made.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0
