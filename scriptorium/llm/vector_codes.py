"""Vector compression by product codes: each part of a vector becomes the number of its nearest codebook entry.

Vectors are integers, floor(scale * x), so every step is exact. The codebooks, a bounded array, go to the
tasks; Arrow batches find the nearest entries by ``|x|^2 - 2 x.c + |c|^2`` with int64 matrix products, and the
first minimum. Each task adds up the vectors of every entry and sends a row an entry; a grouped
shuffle merges these rows, and the entries' floored means are the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise, salted_join, small_batches


@dataclass(frozen=True)
class VectorCodeConfig:
    """scale: of components before they are floored; parts: of a vector; entries: of a codebook, at most 256; rounds of refinement."""

    scale: float = 1024.0
    parts: int = 4
    entries: int = 256
    rounds: int = 4


#: Vectors whose distances to all entries are in memory at once.
_ROWS = 4096


def largest_component(dimension: int) -> int:
    """Components up to this size, either sign, keep squared distances of whole vectors below 2^63."""
    return isqrt(((1 << 63) - 1) // (4 * max(1, dimension)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower of equal ones; squared distance) for each row of int64 ``x``."""
    norms = (book * book).sum(axis=1)
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), _ROWS):
        rows = x[i : i + _ROWS]
        distances = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ book.T) + norms
        at[i : i + _ROWS] = distances.argmin(axis=1)
        far[i : i + _ROWS] = distances.min(axis=1)
    return at, far


def integers(df: DataFrame, config: VectorCodeConfig = VectorCodeConfig()) -> DataFrame:
    """(vec_id, label, vector array<long>) of the rows whose vector has no null or non-finite component; vector is null where a component's floor leaves 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            batch, column = batch.filter(column.is_valid()), column.drop_null()
            flat, lengths = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(lengths)), lengths)
            x = np.floor(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False) * config.scale)
            bad, far = np.zeros(len(lengths), bool), np.zeros(len(lengths), bool)
            bad[of[pc.is_finite(flat).fill_null(False).to_numpy(zero_copy_only=False) == False]] = True  # noqa: E712
            far[of[~(np.abs(x) < 2.0**63)]] = True
            stay = ~bad[of]
            values = np.where(np.abs(x) < 2.0**63, x, 0)[stay].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths[~bad])]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(far[~bad]))
            batch = batch.filter(pa.array(~bad))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vectors], names=["vec_id", "label", "vector"])

    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return small_batches(df).mapInArrow(run, "vec_id long, label string, vector array<long>")


def usable(rows: DataFrame, dimension: int) -> DataFrame:
    """``rows`` with vector null unless it has ``dimension`` components none of which exceeds largest_component."""
    most = largest_component(dimension)
    fits = (F.size("vector") == dimension) & (F.array_max("vector") <= most) & (F.array_min("vector") >= -most)
    return rows.withColumn("vector", F.when(fits, F.col("vector")))


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def first_books(rows: DataFrame, dimension: int, config: VectorCodeConfig) -> np.ndarray:
    """The codebooks (part, entry, component) of the smallest distinct ids: at most ``entries`` rows reach the driver."""
    first = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(config.entries)
    seeds = np.array([r["vector"] for r in first.orderBy("vec_id").collect()], np.int64).reshape(-1, dimension)
    return np.stack(np.split(seeds, config.parts, axis=1))


def entry_sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (vectors, their componentwise sum)}: one row an entry and task is shuffled, one an entry reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, counts, sums = shared.value, np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        flush = [0]

        def rows_so_far() -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            flat = pa.array(sums[part, entry].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "sums"])

        for batch in batches:
            x = _matrix(batch, parts * width)
            size = int(np.abs(x).max(initial=0)) * len(x)
            if flush[0] + size >= 1 << 62:  # sums of very large components go on before they leave 64 bits
                yield rows_so_far()
                counts[:], sums[:], flush[0] = 0, 0, 0
            flush[0] += size
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                at, _ = nearest(own, books[p])
                order = np.argsort(at, kind="stable")
                hit, start = np.unique(at[order], return_index=True)
                counts[p] += np.bincount(at, minlength=entries)
                if len(hit):
                    sums[p, hit] += np.add.reduceat(own[order], start, axis=0)
        yield rows_so_far()

    partial = small_batches(rows.filter("vector IS NOT NULL").select("vector")).mapInArrow(add, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in merged}


def refined(books: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """Each entry's floored mean; entries without vectors stay."""
    books = books.copy()
    for (part, entry), (n, total) in sums.items():
        books[part, entry] = [s // n for s in total]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) by ``books``; code and error are null for rows whose vector is null."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            known = batch.column("vector").is_valid().to_numpy(zero_copy_only=False)
            x = _matrix(batch, parts * width)
            codes, errors = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, far = nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), books[p])
                codes[:, p], errors = at, errors + far
            texts = iter(codes.tobytes().hex(" ", parts).split(" ")) if len(x) else iter(())
            code = [next(texts) if k else None for k in known]
            error = np.zeros(len(known), np.int64)
            error[known] = errors
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=~known)], names=["vec_id", "label", "code", "error"])

    return small_batches(rows).mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(df: DataFrame, config: VectorCodeConfig = VectorCodeConfig()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of ``df`` (vec_id, embedding, label; other columns are ignored) with a finite vector.

    Rows without a vector, or with a null, NaN or infinite component, are left out. The smallest id's vector sets
    the number of components. Rows of another length, and of components whose distances would leave 64 bits, stay with null code and
    error and take no part in codebooks. Of several vectors under one of the smallest ids the least starts an entry; rows without an id start none. Equal
    rows have equal results. label_error leaves null errors out. With fewer ids than entries the codebooks are smaller; without any, no row has a code. An empty table gives an empty table.
    """
    if config.entries > 256:
        raise ValueError("an entry's number must fit in two hexadecimal digits")
    rows = materialise(integers(df, config), "vectors")
    least = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL").agg(F.min(F.struct("vec_id", F.size("vector").alias("size"))).alias("m")).first()["m"]
    dimension = least["size"] if least else 0
    if dimension % config.parts:
        raise ValueError(f"vectors of {dimension} components can't be cut into {config.parts} equal parts")
    rows = usable(rows, dimension)
    books = first_books(rows, dimension, config) if dimension else np.empty((config.parts, 0, 0), np.int64)
    if not books.shape[1]:
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    for _ in range(config.rounds):
        books = refined(books, entry_sums(rows, books))
    # Labels as keys that tell null from every text; a label may hold a large share of the rows.
    found = coded(rows, books).withColumn("key", F.when(F.col("label").isNull(), "0").otherwise(F.concat(F.lit("1"), "label")))
    found = materialise(found.drop("label").withColumn("row", F.monotonically_increasing_id()), "codes")
    errors = found.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    found = salted_join(found, errors, "key", "n", "row", found.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
