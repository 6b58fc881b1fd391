"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets follow from weights by filling up: a source's target stops at ``most_repeats`` times its
size and the excess is shared anew by weight. The mix's blocks are then seats: sources get them by
highest quotients ``target / (2 s + 1)``, and each source's seats go to its shards the same way, by
the shards' words. A shard is a seeded random part of a source's documents in seeded order; its
words are cut into blocks of ``block`` words. A shard takes all its blocks as often as its quota
covers them and, for the rest of the quota, a run of blocks from a seeded start.

Shards bound what one task gathers, also for a source that holds most rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh, materialise, small_batches

_WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """weights repeat over the sources in code-point order (null last); percent: the mix's size against all words."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most_repeats: int = 2
    block: int = 32
    shard_docs: int = 4096
    most_shards: int = 8192
    seed: int = 20


def sainte_lague(votes: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients ``votes / (2 s + 1)``, at most ``caps``; ties go to the earlier party.

    A divisor that gives no more than ``seats`` by rounding is found by bisection; the few seats
    left are dealt one by one. Rounding by a divisor is what dealing by highest quotients comes to.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum())) if len(votes) else 0
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def dealt(divisor: float) -> np.ndarray:
        # A quotient votes / (2 s + 1) above divisor / 2 wins its seat.
        return np.minimum(np.ceil(np.minimum(votes / divisor, 4e18) - 0.5).clip(0), caps).astype(np.int64)

    low, high = votes.sum() / seats, votes.sum() / seats
    while dealt(low).sum() < seats and low > votes.max() * 1e-15:
        low /= 2
    while dealt(high).sum() > seats:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if dealt(middle).sum() <= seats else (middle, high)
    given = dealt(high)
    heap = [(-votes[i] / (2 * given[i] + 1), i) for i in range(len(votes)) if given[i] < caps[i] and votes[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from rows of (source, size): a row for each source.

    A null source is a source, the last; null sizes don't occur (sized gives 0); an empty table gives an empty table.
    The windows without partition run over one row for each source, after aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    k = len(config.weights)
    order = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in config.weights]), (order % k + 1).cast("int")))
    per = per.withColumn("most", config.most_repeats * F.col("source_size"))
    # By ratio of cap to weight: those before an uncapped source are capped. Sums are of integers, so they're exact.
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    per = per.withColumn("capped_before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    per = per.withColumn("budget", F.sum("source_size").over(everything) * config.percent / 100)
    per = per.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_from"))
    per = per.withColumn("free", F.col("most") > F.col("level") * F.col("weight"))
    # The first source that isn't capped sets the level for all the rest.
    per = per.withColumn("level", F.min(F.when(F.col("free"), F.struct("capped_before", "level"))).over(everything)["level"])
    per = per.withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double")))
    return per.select("source", "source_size", "n_docs", "weight", "target")


def _seats(config: MixConfig):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source", na_position="last", ignore_index=True)
        total = int(round(group["target"].sum() / config.block))
        caps = config.most_repeats * -(-group["source_size"].to_numpy() // config.block)
        group["seats"] = sainte_lague(group["target"].to_numpy(), caps, total)
        return group

    return run


def _quotas(config: MixConfig):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", ignore_index=True)
        blocks = -(-group["words"].to_numpy() // config.block)
        group["quota"] = sainte_lague(group["words"].to_numpy(), config.most_repeats * blocks, int(group["seats"].iloc[0]))
        return group

    return run


def plan(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``docs`` (key, doc_id, source, size) with source_size, target, and what each row gives to the mix.

    times: whole copies; from_word and to_word: further words [from_word, to_word) of the row, and
    again from the row's start up to wrap_to, where a run of blocks goes round the shard.
    """
    sources = targets(docs, config)
    sources = materialise(sources.groupBy(F.lit(0).alias("all")).applyInPandas(_seats(config), "source string, source_size long, n_docs long, weight long, target double, seats long"), "mix_sources")
    shards = F.greatest(F.lit(1), F.least(F.lit(config.most_shards), F.ceil(F.col("n_docs") / config.shard_docs)))
    rows = docs.join(sources.withColumnRenamed("source", "of_source").withColumn("shards", shards.cast("long")), F.col("source").eqNullSafe(F.col("of_source")))
    seeded = F.xxhash64(F.lit(config.seed), F.coalesce("doc_id", F.lit(-1)), "size")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(config.seed + 1), seeded), F.col("shards"))).withColumn("at", seeded)
    per_shard = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    quotas = per_shard.groupBy("source").applyInPandas(_quotas(config), "source string, shard long, words long, seats long, quota long")
    quotas = materialise(quotas, "mix_quotas").select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "words", "quota")
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    order = Window.partitionBy("source", "shard").orderBy("at", "doc_id", "size", "key")
    rows = rows.withColumn("begins", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    blocks = F.ceil(F.col("words") / config.block).cast("long")
    rows = rows.withColumn("times", F.when(blocks > 0, F.floor(F.col("quota") / blocks)).otherwise(0).cast("long"))
    rows = rows.withColumn("run", F.col("quota") - F.col("times") * blocks)
    rows = rows.withColumn("start", F.when(blocks > 0, F.pmod(F.xxhash64(F.lit(config.seed + 2), "source", "shard"), blocks)).otherwise(0) * config.block)
    rows = rows.withColumn("stop", F.col("start") + F.col("run") * config.block)
    inside = lambda x: F.least(F.greatest(x - F.col("begins"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("from_word", inside(F.col("start"))).withColumn("to_word", inside(F.col("stop")))
    rows = rows.withColumn("wrap_to", inside(F.greatest(F.col("stop") - blocks * config.block, F.lit(0))))
    return rows.select("key", "doc_id", "source", "size", "source_size", "target", "times", "from_word", "to_word", "wrap_to")


def sized(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size) of each row; key tells rows with one doc_id apart where their texts differ."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    return docs.select(F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def mix_report(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source; others are ignored).

    Null texts have size 0 and give nothing; a null source is a source, the last. Rows that are
    alike in all three columns may share their source's words in any order. Reruns agree.
    """
    rows = plan(materialise(sized(docs), "mix_sizes"), config)
    taken = F.col("size") * F.col("times") + F.col("to_word") - F.col("from_word") + F.col("wrap_to")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text: str, start: int, stop: int) -> str:
    """Words [start, stop) of a text with the white space between them."""
    begin = end = None
    for i, m in enumerate(_RUN.finditer(text)):
        if i == start:
            begin = m.start()
        if i == stop - 1:
            end = m.end()
            break
    return text[begin:end]


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix: rows of ``docs`` with all their columns, as often as taken; a part that is taken once more has its words only.

    n_chars (if there) is counted anew. A null text gives nothing; a null doc_id is one id; rows that are alike in doc_id,
    text and source have a plan each. An empty table gives an empty table.
    """
    of, key, at, source, of_place, place, plan_of = fresh(docs, "mix_of", "mix_key", "mix_id", "mix_source", "mix_of_place", "mix_place", "mix_plan")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    parts = plan(materialise(sized(docs), "mix_sizes"), config)
    parts = materialise(parts.select(F.col("doc_id").alias(at), F.col("key").alias(key), F.col("source").alias(source), F.struct("times", "from_word", "to_word", "wrap_to", "size").alias(plan_of)), "mix_plans")
    keyed = docs.withColumn(of, F.xxhash64("text"))
    if parts.groupBy(at, key, source).count().filter("count > 1").isEmpty():
        parts, keyed = parts.withColumn(place, F.lit(1)), keyed.withColumn(of_place, F.lit(1))
    else:
        parts = parts.withColumn(place, F.row_number().over(Window.partitionBy(at, key, source).orderBy(plan_of)))
        keyed = keyed.withColumn(of_place, F.row_number().over(Window.partitionBy("doc_id", of, "source").orderBy(F.lit(0))))
    parts = parts.filter(f"{plan_of}.times > 0 OR {plan_of}.to_word > {plan_of}.from_word OR {plan_of}.wrap_to > 0")
    keyed = keyed.join(parts, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.col(of) == F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(of_place) == F.col(place)))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (text, p) in enumerate(zip(batch.column("text").to_pylist(), batch.column(plan_of).to_pylist(), strict=True)):
                new = [text] * p["times"]
                for start, stop in ((p["from_word"], p["to_word"]), (0, p["wrap_to"])):
                    if stop > start:
                        new.append(text if stop - start == p["size"] else _cut(text, start, stop))
                rows += [i] * len(new)
                texts += new
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else taken.column(c) for c in schema.names], names=schema.names)

    out = small_batches(keyed).select(*docs.columns, plan_of).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
