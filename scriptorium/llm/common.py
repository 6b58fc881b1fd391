"""What the operators of this package share: tables, cut lineage, hashing of words, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset and all executors are on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    table = spark.read.schema(schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        files, at = _file_system(table.sparkSession, table.scratch)
        files.delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ from ``df``'s columns (in any case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, key: str, size: str, by: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row for each ``key``; ``size``: its rows in ``left``) without a hot key in one task.

    A key with more than a 1024th of ``rows``, the rows of ``left`` (256 at least), is dealt over
    SALTS tasks by the hash of column ``by``. There are at most 1024 such keys, so their list is broadcast.
    """
    hot = F.col(size) >= max(256, rows // 1024)
    keys = F.broadcast(right.filter(hot).select(F.col(key).alias("__hot")))
    left = left.join(keys, F.col(key) == F.col("__hot"), "left")
    left = left.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))).drop("__hot")
    right = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(size)
    return left.join(right, [key, "__salt"], how).drop("__salt")


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """As ``salted_join``, with the hot keys counted in the table ``counted``, whose ``rows`` ``left`` has; ``right`` isn't shuffled to learn them and may have several rows a key."""
    found = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(256, rows // 1024))
    # At most 1024 keys: a list of values, so neither side is joined to mark them.
    keys = [r[0] for r in found.select(key).collect()]
    if not keys:
        return left.join(right, key, how)
    hot = F.col(key).isin(keys)
    left = left.withColumn("__salt", F.when(hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    right = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches of at most about 4 MB (or one row).

    An executor holds a batch several times over, in direct memory and in Python, for each of its
    tasks. A session that asks for less keeps its own setting.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


# -- words and shingles ------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` touch exactly those ASCII characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_POSITION = odd_constants(64, 17)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    words = list(words)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words; of the whole sequence if it is shorter; none of none."""
    n = len(hashed)
    if not n:
        return hashed
    span = min(width, n)
    total = np.full(n - span + 1, np.uint64(span), np.uint64)
    for i in range(span):
        total += hashed[i : n - span + 1 + i] * _POSITION[i]
    return mix(total)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), width))


# -- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``edges``; nodes without an edge are left out.

    Alternates the large-star and small-star steps until nothing changes. Minima are taken by
    aggregation with map-side combining and joined back by salted keys, so that a hub with very many
    neighbours doesn't meet in one task. Each step is a table in the shared folder; the one before goes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, before = materialise(e, "components"), None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        n = mark["n"]
        if n == 0 or (n, mark["s"]) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = (n, mark["s"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = salted_join(both, least, "u", "n", "v", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = salted_join(large, least, "u", "n", "v", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e, old = materialise(small.distinct(), "components"), e
        discard(old)


def batches_of(frames: Iterator, columns: list[str]) -> Iterator[list[list]]:
    """Each Arrow batch as plain Python lists, one for each of ``columns``."""
    for batch in frames:
        yield [batch.column(c).to_pylist() for c in columns]
