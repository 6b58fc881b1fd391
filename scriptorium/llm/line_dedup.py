"""Line dedup with two Bloom filters, one of keys seen once and one of keys seen twice.

First pass: each task notes in a once-filter the keys of its documents and in a twice-filter
those that it meets in a second document. A task sends only the positions of its set bits, by
block of the filter. A block's filters are merged by ``twice = OR of the twices OR the bits that
two once-filters share``. Second pass: only keys that the merged twice-filter holds are
shuffled; exact counts decide which repeat, and their largest document keeps them.

The filter has a fixed largest size. Beyond its capacity it lets more keys through, which costs
shuffle but changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh, materialise, salted_join, small_batches


@dataclass(frozen=True)
class LineDedupConfig:
    """min_chars, min_docs: which keys count as repeats. Bits: 12 a line (estimated), at least 2^16, at most 2^max_log2_bits (64 MB)."""

    min_chars: int = 20
    min_docs: int = 3
    hashes: int = 4
    max_log2_bits: int = 29
    blocks: int = 64


_WHITE = b" \t\n\x0b\x0c\r"


def line_keys(lines: list[bytes]) -> list[bytes]:
    """The key of each line in UTF-8: ``bytes.lower`` changes A-Z alone."""
    return [x.strip(_WHITE).lower() for x in lines]


def _lines(text: str | None) -> list[bytes]:
    """The lines of a text in UTF-8; a null or empty text has one empty line."""
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _long(key: bytes, chars: int) -> bool:
    """Whether a key has ``chars`` code points, each of 1 to 4 bytes."""
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "surrogatepass")) >= chars)


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _positions(digests: list[bytes], log2_bits: int, hashes: int) -> np.ndarray:
    """The bits of each key (rows), by double hashing of the halves of its digest."""
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    steps = halves[:, :1] + np.arange(hashes, dtype=np.uint64) * (halves[:, 1:] | np.uint64(1))
    return (steps >> np.uint64(64 - log2_bits)).astype(np.int64)


def _own_keys(text: str | None, config: LineDedupConfig) -> list[bytes]:
    """Digests of the distinct keys of a document that are long enough."""
    return [_digest(k) for k in set(line_keys(_lines(text))) if _long(k, config.min_chars)]


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _by_block(bits: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """(block, positions in it as unsigned 32-bit integers) of the set bits."""
    for block, part in enumerate(bits.reshape(blocks, -1)):
        if len(at := np.flatnonzero(np.unpackbits(part, bitorder="little"))):
            yield block, at.astype(np.uint32).tobytes()


def repeat_filter(docs: DataFrame, config: LineDedupConfig) -> tuple[bytes, int]:
    """The merged twice-filter as bytes (at most 2^(max_log2_bits - 3) of them), and the power of two of its size in bits."""
    lines = docs.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).alias("n")).first()["n"] or 0
    log2_bits = int(np.clip(np.ceil(np.log2(12 * max(1, lines))), 16, config.max_log2_bits))
    blocks, hashes = config.blocks, config.hashes

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << log2_bits - 3, np.uint8), np.zeros(1 << log2_bits - 3, np.uint8)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if digests := _own_keys(text, config):
                    at = _positions(digests, log2_bits, hashes)
                    _set(twice, at[_has(once, at).all(axis=1)].ravel())
                    _set(once, at.ravel())
        rows = [(block, bits, kind) for kind, flags in ((False, once), (True, twice)) for block, bits in _by_block(flags, blocks)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())], names=["block", "bits", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held = (1 << log2_bits - 3) // blocks, {}
        for batch in batches:
            for block, bits, is_twice in zip(*(batch.column(c).to_pylist() for c in ("block", "bits", "twice")), strict=True):
                once, twice = held.setdefault(block, (np.zeros(size, np.uint8), np.zeros(size, np.uint8)))
                at = np.frombuffer(bits, np.uint32).astype(np.int64)
                if is_twice:
                    _set(twice, at)
                else:
                    _set(twice, at[_has(once, at)])
                    _set(once, at)
        for block, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["block", "packed"])

    parts = small_batches(docs).select("text").mapInArrow(build, "block int, bits binary, twice boolean")
    merged = parts.repartition(blocks, "block").mapInArrow(merge, "block int, packed binary").collect()
    size = (1 << log2_bits - 3) // blocks
    packed = bytearray(blocks * size)
    for row in merged:
        packed[row["block"] * size : (row["block"] + 1) * size] = row["packed"]
    return bytes(packed), log2_bits


def repeated_lines(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """(doc_id, drop array<binary>): for each document that loses lines, the digests of their keys.

    Rows with a null doc_id belong to no document: they neither count nor lose lines.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    packed, log2_bits = repeat_filter(docs, config)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digests := _own_keys(text, config):
                    at = _positions(digests, log2_bits, config.hashes)
                    for i in np.flatnonzero(_has(bits, at).all(axis=1)):
                        ids.append(doc_id)
                        keys.append(digests[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    # One row for each key and document, also where rows of a document are repeated.
    found = materialise(small_batches(docs).mapInArrow(suspects, "doc_id long, key binary"), "suspect_lines")
    seen = found.distinct()
    repeats = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= config.min_docs)
    # A line of very many documents doesn't meet in one task.
    return salted_join(seen, repeats, "key", "n", "doc_id", found.count()).filter("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("key").alias("drop"))


def _with_drops(docs: DataFrame, config: LineDedupConfig, drop: str) -> DataFrame:
    (at,) = fresh(docs, "drop_id")
    drops = repeated_lines(docs, config).select(F.col("doc_id").alias(at), F.col("drop").alias(drop))
    return docs.join(drops, F.col("doc_id").cast("long") == F.col(at), "left").drop(at)


def _kept(text: str | None, drop: list[bytes] | None, config: LineDedupConfig) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the text that stays."""
    if not drop:
        return (text or "").count("\n") + 1, 0, text or ""
    lines, gone = _lines(text), set(drop)
    stay = [x for x, k in zip(lines, line_keys(lines), strict=True) if not _long(k, config.min_chars) or _digest(k) not in gone]
    return len(lines), len(lines) - len(stay), b"\n".join(stay).decode("utf-8", "surrogatepass")


def line_report(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have one empty line. Repeated rows count once and lose the same lines. A
    text that loses all its lines is empty, as is one that keeps a single empty line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_kept(t, d, config) for t, d in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            sums = [hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in done]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(_with_drops(docs, config, "gone")).select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """``docs`` with all its columns, texts without their repeated lines, and n_chars (if there) counted anew.

    Null texts stay null; rows with a null doc_id stay as they are; repeated rows lose the same lines; no row is dropped.
    An empty table gives an empty table.
    """
    (drop,) = fresh(docs, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column("text").to_pylist(), batch.column(drop).to_pylist()
            new = [_kept(t, d, config)[2] if d else t for t, d in zip(texts, drops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names if c != drop], names=[c for c in batch.schema.names if c != drop])

    out = _with_drops(docs.withColumn("text", F.col("text").cast("string")), config, drop)
    schema = docs.withColumn("text", F.col("text").cast("string")).schema
    out = small_batches(out).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
