"""Document fingerprints by MinHash: universal permutations over word shingles in vectorised numpy.

Permutation i of 64-bit hashes is ``a_i * x + b_i`` (a_i odd); a fingerprint holds the top 16 bits
of the least value under each of 128 permutations as hexadecimal digits. Its likeness to another
is the share of equal values, an estimate of the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import odd_constants, shingle_hashes, word_hashes, words_of
from scriptorium.llm.near_dup import NearDupConfig, near_duplicates, text_digest


@dataclass(frozen=True)
class FingerprintConfig:
    """Words of a shingle and number of permutations; bands and percent serve similar_documents."""

    width: int = 5
    permutations: int = 128
    bands: int = 32
    percent: int = 80


_CHUNK = 2048
_MOST_GROUPS = 8192


def least_values(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """The least value under each permutation; all ones for an empty set."""
    a, b = odd_constants(permutations, 23)[:, None], odd_constants(permutations, 29)[:, None]
    least = np.full(permutations, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), _CHUNK):
        values = a * shingles[None, i : i + _CHUNK]
        values += b
        np.minimum(least, values.min(axis=1), out=least)
    return least


def digits(least: np.ndarray) -> str:
    return (least >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def text_hashes(text: str) -> np.ndarray:
    return word_hashes(words_of(text))


def with_edit(text: str, following: str, config: FingerprintConfig) -> tuple[np.ndarray, str, np.ndarray]:
    """The least values of ``text``, its edited text and the least values of that.

    Shingles inside the common head are permuted once for both.
    """
    cut = len(text) - len(text) // 4
    head, tail, new = text[:cut], text[cut:], following[: len(text) // 4]
    edited = head + new
    # The head's last word may go on in the tail.
    at = max(map(head.rfind, " \t\n\x0b\x0c\r")) + 1
    common = text_hashes(head[:at])
    n, w = len(common), config.width
    if n < w:
        own, other = (least_values(shingle_hashes(text_hashes(x), w), config.permutations) for x in (text, edited))
        return own, edited, other
    shared = least_values(shingle_hashes(common, w), config.permutations)
    keep = common[n - w + 1 :]
    found = []
    for rest in (head[at:] + tail, head[at:] + new):
        hashed = np.concatenate((keep, text_hashes(rest)))
        found.append(np.minimum(shared, least_values(shingle_hashes(hashed, w), config.permutations)) if len(hashed) >= w else shared)
    return found[0], edited, found[1]


def in_order(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with group and tail: sorted by (group, tail, doc_id, text), a row's next row is the next document.

    Groups are ranges of doc_id between quantiles; each is closed by a copy of the first row of the
    next group (tail = true; the very first for the last group). Only the first ids of the groups,
    a fixed number, come to the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = groups or min(4 * n, _MOST_GROUPS)
    ids = docs.select(F.col("doc_id").cast("double").alias("at")).filter("at IS NOT NULL")
    cuts = sorted(set(ids.approxQuantile("at", [i / groups for i in range(1, groups)], 0.2 / groups))) if groups > 1 else []
    docs = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    docs = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="group").transform(docs)
    docs = docs.select("doc_id", "text", F.col("group").cast("int").alias("group"))
    first = F.when(F.max(F.col("doc_id").isNull()), F.lit(None)).otherwise(F.min("doc_id"))
    firsts = docs.select("group", "doc_id").groupBy("group").agg(first.alias("first_id")).orderBy("group").collect()
    if not firsts:
        return docs.withColumn("tail", F.lit(False))
    before = {row["group"]: firsts[i - 1]["group"] for i, row in enumerate(firsts)}
    first_ids = {row["group"]: row["first_id"] for row in firsts}
    known = spark.createDataFrame([(g, before[g], first_ids[g]) for g in before], "group int, before int, first_id long")
    docs = docs.join(F.broadcast(known), "group")  # a row for each group
    closes = F.col("doc_id").eqNullSafe(F.col("first_id"))
    targets = F.when(closes, F.array(F.struct(F.col("group").alias("g"), F.lit(False).alias("t")), F.struct(F.col("before").alias("g"), F.lit(True).alias("t")))).otherwise(F.array(F.struct(F.col("group").alias("g"), F.lit(False).alias("t"))))
    docs = docs.withColumn("to", F.explode(targets)).select("doc_id", "text", F.col("to.g").alias("group"), F.col("to.t").alias("tail"))
    return docs.repartition(n, "group").sortWithinPartitions("group", "tail", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): fingerprints of the text and of its edited text.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of
    the next row's text in the order of doc_id (null first) and then text; the first row follows
    the last. A null text counts as empty; an empty text has a fingerprint of ones only, alike to
    itself. A single row follows itself; repeated rows follow each other. An empty table gives an
    empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, group, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "group", "tail")), strict=True):
                if held and held[2] == group and not held[3]:
                    rows.append((*held[:2], text))
                held = (doc_id, text, group, tail)
            done, after = [], {}
            for i in range(len(rows) - 1, -1, -1):
                doc_id, text, following = rows[i]
                least, edited, other = with_edit(text, following, config)
                if (hashed := after.get(following)) is None:
                    hashed = digits(least_values(shingle_hashes(text_hashes(following), config.width), config.permutations))
                own, new = digits(least), digits(other)
                after = {text: own}
                done.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, hashed)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_order(docs).mapInArrow(run, SCHEMA)


def similarity_classes(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """(doc_id, n_shingles, class_id) for each row of ``docs``: class_id is the smallest id that verified links lead to.

    Documents meet where they share a band of their fingerprints; the hub rounds and the exact prefix
    filter of near_dup find the links between members of one band, and the Jaccard similarity of the
    full shingle sets decides. Copies have the class of their first; a text without words is its own
    class; a null doc_id has none.
    """
    rows = config.permutations // config.bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, salt = odd_constants(rows, 31), odd_constants(config.bands, 37)
        for batch in batches:
            ids, digests, counts, bands = batch.column("doc_id").to_pylist(), [], [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                shingles = np.unique(shingle_hashes(word_hashes(words), config.width))
                least = least_values(shingles, config.permutations).reshape(config.bands, rows)
                counts.append(len(shingles))
                digests.append(text_digest(words, doc_id))
                bands.append(((least * factors).sum(axis=1, dtype=np.uint64) * salt).view(np.int64) if words else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "bands"])

    found = near_duplicates(docs, NearDupConfig(width=config.width, percent=config.percent), sign)
    return found.select("doc_id", "n_shingles", F.col("component_id").alias("class_id"))
