"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find: e-mail and IP addresses, card and phone numbers. Everything else that has such a
shape (a phone number without a plus, a card number that fails its checksum, ``name (at) host (dot) org``, an address of
hexadecimal groups) is a candidate. Two lexical units before a slot, or after it, make a lexical pattern. Patterns and
instances are the two sides of a graph, whose edges Spark counts; in each round a pattern's
confidence is the share of all its occurrences in the corpus, whatever they hold, that known instances of a
kind fill, and an instance's is what its confident patterns say together. Confident instances
are known in the next round. How often a pair of units occurs anywhere is counted over all texts, for the pairs
that a bit filter of fixed largest size lets through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise, salted_join, shingle_hashes, small_batches, word_hashes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)


@dataclass(frozen=True)
class PiiConfig:
    """support: distinct known instances that a pattern needs; precision: confidence that a pattern and an instance need, in thousandths; rounds: at most.

    max_listed: unit pairs of patterns that each task holds as a list (8 MB), beyond which a filter stands for them.
    max_log2_bits: of that filter (8 MB); a fuller one lets more pairs through to the exact count.
    """

    support: int = 3
    precision: int = 600
    rounds: int = 4
    max_listed: int = 1 << 20
    max_log2_bits: int = 26


# -- one text ----------------------------------------------------------------------------------

# The domain of an address; each label is taken whole, as no dot is in a label.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from all others, so none is tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Shapes of candidates.
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
_GROUPS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")
_AT = re.compile(r"(?:\x20?[(\[{]at[)\]}]\x20?|@)[A-Za-z0-9-]++(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\.)[A-Za-z0-9-]+)*|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]+)+")
_SPELT_AT, _SPELT_DOT = re.compile(r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20"), re.compile(r"\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_UNIT = re.compile(r"\w+|[^\w\s]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _addresses(text: str, marks: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of addresses with a local part before each (start, end) of ``marks``, leftmost first, without overlaps."""
    last = 0
    for at, end in marks:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, end
            last = end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    def marks() -> Iterator[tuple[int, int]]:
        at = text.find("@")
        while at >= 0:
            if m := _DOMAIN.match(text, at):
                yield at, m.end()
            at = text.find("@", at + 1)

    return _addresses(text, marks())


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) in code points of what the fixed patterns find, ordered; matches that fail their check aren't tried again."""
    found = [(a, EMAIL, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    if "+" in text:
        found += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return sorted(found)


def _touches(span: Span, taken: list[Span], ends: list[int]) -> bool:
    """Whether a span of ``taken``, ordered by start, overlaps; ``ends``: the furthest end so far."""
    before = bisect_left(taken, (span[2],))
    return before > 0 and ends[before - 1] > span[0]


def candidate_spans(text: str, taken: list[Span]) -> list[Span]:
    """(start, kind, end) of what has a kind's shape and touches no span of ``taken``; a number can be of several kinds."""
    ends = list(accumulate((s[2] for s in taken), max))
    found = [(a, EMAIL, b) for a, b in _addresses(text, ((m.start(), m.end()) for m in _AT.finditer(text)))]
    found += [(m.start(), IP, m.end()) for m in _GROUPS.finditer(text) if any(c.isdigit() for c in m.group())]

    def number(start: int, end: int) -> None:
        own = text[start:end]
        n = len(_NOT_DIGITS.sub("", own))
        if own.count(".") == 3 and re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", own):
            found.append((start, IP, end))
        if 12 <= n <= 19:
            found.append((start, CARD, end))
        if 7 <= n <= 15:
            found.append((start, PHONE, end))
        elif n > 19 and " " in own:  # numbers in a row
            for m in re.finditer(r"[^\x20]+", own):
                if m.end() - m.start() < len(own):
                    number(start + m.start(), start + m.end())

    for m in _NUMBER.finditer(text):
        number(m.start(), m.end())
    return [s for s in sorted(found) if not _touches(s, taken, ends)]


def instance(kind: int, text: str) -> str:
    """What is the same however it is written: digits of numbers, addresses in lower case with signs for words."""
    if kind == EMAIL:
        return _SPELT_DOT.sub(".", _SPELT_AT.sub("@", text)).lower()
    return text.lower() if kind == IP else _NOT_DIGITS.sub("", text)


def _unit(word: str) -> bytes:
    return b"0" if word.isdecimal() else word.lower().encode("utf-8", "surrogatepass")


START, END = [b"\x02", b"\x02"], [b"\x03", b"\x03"]


def pairs_of(text: str) -> np.ndarray:
    """Hashes of all pairs of neighbouring units, with two marks before and behind the text."""
    return shingle_hashes(word_hashes([*START, *map(_unit, _UNIT.findall(text)), *END]), 2)


def around(text: str, start: int, end: int) -> tuple[int, int]:
    """Hashes of the two units before and of the two units behind a span."""

    def side(take, size: int) -> list[str]:
        reach = 64
        while True:
            units = _UNIT.findall(take(reach))
            if len(units) > 2 or reach >= size:
                return units
            reach *= 2

    left = [_unit(u) for u in side(lambda n: text[max(0, start - n) : start], start)[-2:]]
    right = [_unit(u) for u in side(lambda n: text[end : end + n], len(text) - end)[:2]]
    pair = lambda units: int(shingle_hashes(word_hashes(units), 2).view(np.int64)[0])
    return pair([*START, *left][-2:]), pair([*right, *END][:2])


def _number(kind: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind} {instance(kind, text)}".encode("utf-8", "surrogatepass")) - (1 << 63)


# -- all texts ---------------------------------------------------------------------------------

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_USE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("before", pa.int64()), ("behind", pa.int64())])
FOUND = "doc_id long, base array<struct<start: int, kind: int, end: int>>, uses array<struct<start: int, kind: int, end: int, seed: boolean, instance: long, before: long, behind: long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, uses = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            own = [(*s, True) for s in base] + [(*s, False) for s in candidate_spans(text, base)]
            bases.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
            uses.append([dict(zip(_USE.names, (*s, _number(s[1], text[s[0] : s[2]]), *around(text, s[0], s[2])), strict=True)) for s in own])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, pa.list_(_SPAN)), pa.array(uses, pa.list_(_USE))], names=["doc_id", "base", "uses"])


def listed_counts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, total): occurrences in all texts of the pairs in ``pairs`` (pair), of which each task counts all of its texts and holds the list."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(pairs.toArrow().column("pair").to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        totals = np.zeros(len(listed), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = pairs_of(text or "").view(np.int64)
                at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
                np.add.at(totals, at[listed[at] == own], 1)
        (met,) = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(listed[met]), pa.array(totals[met])], names=["pair", "n"])

    return small_batches(docs.select("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total"))


def pair_counts(docs: DataFrame, pairs: DataFrame, config: PiiConfig) -> DataFrame:
    """(pair, total): occurrences in all texts of the pairs in ``pairs`` (pair; one at least), and, beyond ``max_listed`` of them, of some others that the filter lets through."""
    n = pairs.count()
    if n <= config.max_listed:
        return listed_counts(docs, pairs)
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, n))), 12, config.max_log2_bits))
    # Two bits of each pair; words of 64 bits are put together by Spark, at most 2^20 of them reach the driver.
    spots = [F.shiftrightunsigned("pair", 64 - bits), F.shiftrightunsigned(F.shiftleft("pair", 32), 64 - bits)]
    words = pairs.select(F.explode(F.array(*spots)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    packed = np.zeros(1 << max(0, bits - 6), np.int64)
    table = words.toArrow()
    packed[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(packed.view(np.uint64))
    shift = np.uint64(64 - bits)

    def has(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            kept = [np.empty(0, np.uint64)]
            for text in batch.column("text").to_pylist():
                own = pairs_of(text or "")
                own = own[has(words, own >> shift)]
                kept.append(own[has(words, (own << np.uint64(32)) >> shift)])
            pair, n = np.unique(np.concatenate(kept), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return small_batches(docs.select("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total"))


def known_instances(docs: DataFrame, found: DataFrame, config: PiiConfig) -> DataFrame:
    """(instance): the seeds' and those that confident patterns add, round by round.

    ``found``: rows of FOUND. An edge of the graph is a pattern (kind, side, pair) with an instance and its number of occurrences.
    """
    uses = found.select(F.inline("uses"))
    side = lambda name, column: F.struct(F.lit(name).alias("side"), F.col(column).alias("pair"))
    slots = uses.select("kind", "instance", "seed", F.inline(F.array(side("before", "before"), side("behind", "behind"))))
    slots = slots.withColumn("pattern", F.xxhash64("kind", "side", "pair"))
    edges = materialise(slots.groupBy("pattern", "pair", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "pattern_uses")
    # The seeds are known for certain.
    known = materialise(edges.filter("seed").select("instance").distinct().withColumn("score", F.lit(1000).cast("long")), "known")
    patterns = edges.groupBy("pattern", "pair").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("filled")).filter(F.col("instances") >= config.support)
    patterns = materialise(patterns, "patterns")
    n_edges = edges.count()
    if patterns.isEmpty():
        return known.select("instance")
    totals = materialise(pair_counts(docs, patterns.select("pair").distinct(), config), "pair_totals")
    patterns = materialise(patterns.join(totals, "pair").select("pattern", "instances", F.greatest("total", "filled").alias("total")), "patterns")
    edges = materialise(salted_join(edges, patterns.select("pattern", "instances"), "pattern", "instances", "instance", n_edges).select("pattern", "instance", "n"), "edges")
    degrees = materialise(edges.groupBy("instance").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    rows, seeds, before = edges.count(), known, None
    for _ in range(config.rounds):
        held = known.join(degrees, "instance")
        filled = salted_join(edges, held, "instance", "degree", "pattern", rows).groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.sum(F.col("n") * F.col("score")).alias("weight"))
        confidence = F.least(F.floor(F.col("weight") / F.col("total")), F.lit(999)).cast("long")
        confident = patterns.join(filled.filter(F.col("support") >= config.support), "pattern").withColumn("confidence", confidence).filter(F.col("confidence") >= config.precision)
        confident = materialise(confident.select("pattern", "instances", "confidence"), "confident")
        # What is left of the doubt, in whole millionths of its logarithm, so that the sum is exact in any order.
        doubt = F.round(-1e6 * F.log(1 - F.col("confidence") / 1000)).cast("long")
        judged = salted_join(edges, confident, "pattern", "instances", "instance", rows).groupBy("instance").agg(F.sum(doubt).alias("doubt"))
        score = F.floor(1000 * (1 - F.exp(F.col("doubt") / -1e6))).cast("long")
        added = judged.withColumn("score", score).filter(F.col("score") >= config.precision).select("instance", "score")
        known = materialise(seeds.unionByName(added.join(seeds, "instance", "left_anti")), "known")
        mark = known.agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")).first()
        if (mark["n"], mark["s"]) == before:
            break
        before = (mark["n"], mark["s"])
    return known.select("instance")


def personal_data(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """(doc_id, base, added) for each row of ``docs`` (doc_id, text; other columns are ignored): spans (start, kind, end) in code points, ordered.

    Null and empty texts have no spans. ``added`` holds candidates whose instance is known at the end; of several kinds the
    first of KINDS. It overlaps no base span and no other added one. Equal texts have equal spans; repeated rows and rows without an
    id stay as they are. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = small_batches(docs).mapInArrow(_scan, FOUND).withColumn("row", F.monotonically_increasing_id())
    found = materialise(found, "spans")
    known = known_instances(docs, found, config)
    open_uses = found.select("row", F.inline("uses")).filter("NOT seed")
    sizes = open_uses.groupBy("instance").agg(F.count(F.lit(1)).alias("size")).join(known, "instance")
    hits = salted_join(open_uses, sizes, "instance", "size", "row", open_uses.count())
    added = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("hits"))
    # In the order of starts and kinds, whatever begins before the last one's end goes.
    empty = F.expr("cast(array() AS array<struct<start: int, kind: int, end: int>>)")
    apart = F.aggregate("hits", empty, lambda spans, x: F.when((F.size(spans) == 0) | (x["start"] >= F.try_element_at(spans, F.lit(-1))["end"]), F.concat(spans, F.array(x))).otherwise(spans))
    added = added.select("row", apart.alias("added"))
    return found.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def report(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts of base spans by kind, the digest of their list, and the list of all spans."""
    found = personal_data(docs, config)
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "added"))).alias("spans"))
