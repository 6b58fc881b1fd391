"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a small table, often one row group, would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches of at most about 4 MB (or one row): whole texts by ten thousands fill an executor's Python.

    A session that asks for less keeps its own setting.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only under a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: every later stage sees the same rows, and lost executors cost nothing. It goes when the application ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ from ``df``'s columns (in any case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def newest(rows: DataFrame, key: list[str | Column], order: list[str | Column], most: int) -> DataFrame:
    """The ``most`` first rows of each key in ``order``; the limit runs before the shuffle."""
    (place,) = fresh(rows, "place")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(place) <= most).drop(place)
