"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Every distinct shingle is hashed once; the hash range is cut into ``bands * rows`` bins and a
bin's value is its smallest hash. An empty bin borrows from a bin that its own random sequence
of bins meets first (optimal densification), so the values of two documents agree with a
probability close to their Jaccard similarity. ``rows`` values make a band's bucket.

Copies (equal word sequences) are folded to their smallest id first. Within a bucket only
stars are compared: a hub against the other members, never all pairs. The hub is the member whose
buckets are the fullest, the one most central to a group of near copies. The first round tries
for each document only the most central of its hubs. After each round components are taken; buckets
whose members lie in several components get a further hub, ``hub_rounds`` times. What is left in such
buckets is settled exactly by prefix filtering: of two sets that are similar enough, the parts of
``n - ceil(t n) + 1`` shingles that are rarest among these documents share one, and so early that what
follows in both sets still suffices (the positional filter). Documents with a
frequent passage in common have rare shingles of their own there, so such groups don't meet again,
and no candidate link is lost. Pairs whose set sizes alone rule out the similarity are not compared.
Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import components, discard, fresh, hot_join, materialise, mix, odd_constants, salted_join, shingle_hashes, small_batches, word_hashes, words_of


@dataclass(frozen=True)
class NearDupConfig:
    """Link when ``100 * intersection >= percent * union``; at 0.8 a link misses all 36 buckets of 6 rows in 2 of 10^5 cases, at 0.85 in 4 of 10^8."""

    width: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 6
    hub_rounds: int = 3


_DRAWS: dict[tuple[int, int], np.ndarray] = {}


def _draws(bins: int, block: int) -> np.ndarray:
    """Block ``block`` of 64 draws for each bin: the fixed random sequence of bins that it borrows from."""
    if (bins, block) not in _DRAWS:
        at = np.arange(64 * bins, dtype=np.uint64) + np.uint64(block * 64 * bins + 1)
        _DRAWS[bins, block] = ((mix(at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64).reshape(64, bins)
    return _DRAWS[bins, block]


def one_permutation_signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The densified bins of a non-empty sorted array of distinct hashes."""
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[place[first]], full[place[first]] = hashes[first], True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        draws = _draws(bins, block)[:, empty]
        hit = full[draws]
        found = hit.any(axis=0)
        values[empty[found]] = values[draws[hit.argmax(axis=0), np.arange(len(empty))][found]]
        empty, block = empty[~found], block + 1
    return values


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factors = odd_constants(rows, 5)
    return mix((signature.reshape(bands, rows) * factors).sum(axis=1, dtype=np.uint64) + odd_constants(bands, 11)).view(np.int64)


def text_digest(words: list[bytes], doc_id: int | None) -> str:
    """A name for the sequence of words; a text without words has one of its own."""
    return xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else f"empty {doc_id}"


def part_of(digest: str) -> int:
    """A number that tells the texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(digest) >> 1


Signer = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SIGNED = "doc_id long, digest string, n_shingles long, bands array<long>"


def _sign(config: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, counts, bands = batch.column("doc_id").to_pylist(), [], [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                shingles = np.unique(shingle_hashes(word_hashes(words), config.width))
                counts.append(len(shingles))
                digests.append(text_digest(words, doc_id))
                bands.append(band_keys(one_permutation_signature(shingles, config.bands * config.rows), config.bands, config.rows) if len(shingles) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "bands"])

    return run


def _sets(config: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, parts = batch.column("doc_id").to_pylist(), [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                sets.append(np.unique(shingle_hashes(word_hashes(words), config.width)).view(np.int64))
                parts.append(part_of(text_digest(words, doc_id)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "part", "shingles"])

    return run


def _confirm(config: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at_a, a), (at_b, b) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("set_a"), batch.column("set_b")))
            linked = []
            for i in range(batch.num_rows):
                one, two = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(both > 0 and 100 * both >= config.percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig(), sign: Signer | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts, and texts without words, have no shingle and are linked with nothing.
    Rows with a null doc_id have the component of equal words, if there are any, and kept = false. Repeated rows give
    repeated rows; texts under one doc_id are one node, which has the links of each. An empty table gives an
    empty table. ``sign`` gives rows of SIGNED with band keys of its own in place of one-permutation hashing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(small_batches(docs).mapInArrow(sign or _sign(config), SIGNED), "signed")
    nodes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = nodes.count()
    copies = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    copies = materialise(copies.filter("copies > 1 AND first_id IS NOT NULL"), "copies")
    firsts = salted_join(nodes, copies, "digest", "copies", "doc_id", rows, "left").filter("first_id IS NULL OR doc_id = first_id")
    entries = firsts.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = materialise(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    n_bands = config.bands if sign is None else nodes.agg(F.max(F.size("bands"))).first()[0] or 1
    members = salted_join(entries, shared.withColumn("n", F.col("size")), "bucket", "n", "doc_id", rows * n_bands)
    members = materialise(members.select("bucket", "doc_id", "n_shingles", "size"), "entries")
    central = members.groupBy("doc_id").agg(F.sum("size").alias("central"))
    members, entries = materialise(members.drop("size").join(central, "doc_id").select("bucket", "doc_id", "n_shingles", "central"), "members"), members
    discard(entries)
    labels = _linked(docs, members, shared, config)
    # An id with several texts has the links of each: it and the first ids of its texts are linked.
    mark = F.xxhash64("digest")
    several = nodes.groupBy("doc_id").agg(F.min(mark).alias("least"), F.max(mark).alias("most")).filter("least < most").select("doc_id")
    several = materialise(several.join(nodes.select("doc_id", "digest"), "doc_id").distinct(), "several_texts")
    if not several.isEmpty():
        own = several.join(copies.select("digest", "first_id"), "digest").filter("first_id <> doc_id")
        labels = _merged(labels, own.select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")))
    result = salted_join(signed, copies, "digest", "copies", "doc_id", rows, "left").select("doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("first_id"))
    labels = labels.select(F.col("node").alias("first_id"), "label")
    result = result.join(labels, "first_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "first_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _linked(docs: DataFrame, members: DataFrame, shared: DataFrame, config: NearDupConfig) -> DataFrame:
    """(node, label) of all nodes that some confirmed link reaches. ``shared``: the buckets of ``members`` and their sizes."""
    # A table of its own, so that its size decides whether the texts are shuffled to find the candidates'.
    ids = materialise(members.select("doc_id").distinct(), "candidates")
    texts = docs.join(ids, "doc_id", "left_semi")
    sets = small_batches(texts).mapInArrow(_sets(config), "doc_id long, part long, shingles array<long>")
    sets = materialise(sets, "candidate_sets")
    n_members = members.count()

    def by_bucket(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return salted_join(left, right.join(shared, "bucket"), "bucket", "size", "doc_id", n_members, how)

    def confirmed(pairs: DataFrame) -> DataFrame:
        # A hub, on either side, with very many pairs is dealt over several tasks.
        pairs = materialise(pairs, "pairs")
        rows = pairs.count()
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        found = hot_join(hot_join(pairs, right, "b", "a", pairs, rows), left, "a", "b", pairs, rows).select("a", "b", "set_a", "set_b")
        links = materialise(small_batches(found).mapInArrow(_confirm(config), "a long, b long, linked boolean").filter("linked").select("a", "b").distinct(), "links")
        discard(pairs)
        return links

    alike = 100 * F.least("n_shingles", "n_hub") >= config.percent * F.greatest("n_shingles", "n_hub")
    hub = F.max(F.struct("central", (-F.col("doc_id")).alias("minus"), "n_shingles"))
    stars = members.groupBy("bucket").agg(hub.alias("hub")).select("bucket", F.col("hub.central").alias("of"), (-F.col("hub.minus")).alias("a"), F.col("hub.n_shingles").alias("n_hub"))
    first = by_bucket(members, stars).filter((F.col("doc_id") != F.col("a")) & alike)
    first = first.groupBy(F.col("doc_id").alias("b")).agg(F.max(F.struct("of", (-F.col("a")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), "b")
    links = confirmed(first)
    labels = materialise(components(links, "a", "b"), "labels")
    rest, read = members, []
    for turn in range(config.hub_rounds + 1):
        known = labels.select(F.col("node").alias("doc_id"), "label")
        # A table, as the mixed buckets and what is left both read it: their shuffles differ by the salt.
        labelled = materialise(rest.drop("label").join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "labelled")
        discard(*read)
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("bucket")
        rest = materialise(by_bucket(labelled, mixed, "left_semi"), "rest")
        discard(labelled)
        if rest.isEmpty():
            return labels
        if turn == config.hub_rounds:
            break
        # The most central member first, by map-side aggregation: a large bucket isn't gathered.
        best = F.max(F.struct("central", (-F.col("doc_id")).alias("minus"), "label", "n_shingles"))
        chosen = rest.groupBy("bucket").agg(best.alias("hub")).select("bucket", (-F.col("hub.minus")).alias("a"), F.col("hub.label").alias("label_a"), F.col("hub.n_shingles").alias("n_hub"))
        chosen = materialise(chosen, "hubs")
        pairs = by_bucket(rest, chosen).filter((F.col("label") != F.col("label_a")) & alike)
        links = confirmed(pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct())
        if not links.isEmpty():
            labels, old = _merged(labels, links), labels
            discard(old)
        discard(links)
        read = [rest, chosen]
        # A hub has met its whole bucket; the key holds the document too, so no bucket meets in one task.
        rest = rest.join(chosen.select("bucket", F.col("a").alias("doc_id")), ["bucket", "doc_id"], "left_anti")
    links = confirmed(_by_prefix(sets, rest.select("doc_id", "label").distinct(), config))
    return labels if links.isEmpty() else _merged(labels, links)


def _by_prefix(sets: DataFrame, nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """(a, b): pairs of ``nodes`` (doc_id, label) with different labels whose prefixes share a shingle early enough."""

    own = sets.join(nodes.select("doc_id"), "doc_id", "left_semi").select("doc_id", "part", F.explode("shingles").alias("shingle"))
    own = materialise(own, "prefix_shingles")
    counts = materialise(own.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle_counts")
    # A text's rare part is collected for itself: no more than its own shingles.
    counted = salted_join(own, counts.withColumn("size", F.col("n")), "shingle", "size", "doc_id", own.count())
    ranked = counted.groupBy("doc_id", "part").agg(F.sort_array(F.collect_set(F.struct("n", "shingle"))).alias("ranked"))
    percent, n = config.percent, F.size("ranked")
    head = F.slice("ranked", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))
    placed = ranked.select("doc_id", n.alias("n"), F.posexplode(head).alias("at", "x")).filter("x.n > 1")
    # What is left of a set from a shingle on bounds how much two sets share if it is the first that they share.
    prefix = placed.select("doc_id", "n", (F.col("n") - F.col("at")).alias("left"), "x.shingle").join(nodes, "doc_id")
    prefix = materialise(prefix, "prefixes")
    mixed = prefix.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("shingle")
    rows = prefix.count()
    prefix = materialise(hot_join(prefix, mixed, "shingle", "doc_id", prefix, rows, "left_semi"), "prefix_mixed")
    # The smaller set of a pair must hold the shingle in about the first half of its prefix.
    small = prefix.filter((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))
    small = small.select("shingle", F.col("doc_id").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    ordered = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("a") < F.col("doc_id")))
    enough = (100 + percent) * F.least("left_a", "left") >= percent * (F.col("n_a") + F.col("n"))
    pairs = hot_join(prefix, small, "shingle", "doc_id", prefix, prefix.count()).filter((F.col("label") != F.col("label_a")) & ordered & enough)
    return pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: components of the labels' own, much smaller, graph."""
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        ends = ends.join(known, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    ends = materialise(ends, "label_links")
    above = materialise(components(ends, "label_a", "label_b"), "label_labels").select(F.col("node").alias("label"), F.col("label").alias("above"))
    nodes = labels.select("node", "label").unionByName(ends.select(F.col("a").alias("node"), F.col("label_a").alias("label"))).unionByName(ends.select(F.col("b").alias("node"), F.col("label_b").alias("label"))).distinct()
    return materialise(nodes.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")


def first_of_each(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs`` with all its columns, one row of each group of near-duplicates: the smallest id.

    Of several rows under that id the one with the least text stays (of equal ones any). Rows with a null doc_id are in
    no group and all stay. An empty table gives an empty table.
    """
    found = materialise(near_duplicates(docs, config).filter("doc_id IS NOT NULL"), "groups")
    at, place = fresh(docs, "group_id", "group_place")
    gone = materialise(found.filter("NOT kept").select(F.col("doc_id").alias(at)).distinct(), "group_rest")
    stay = docs.join(gone, F.col("doc_id").cast("long") == F.col(at), "left_anti")
    twice = materialise(found.filter("kept").groupBy(F.col("doc_id").alias(at)).count().filter("count > 1").select(at), "group_repeats")
    if twice.isEmpty():
        return stay
    same = F.col("doc_id").cast("long") == F.col(at)
    order = Window.partitionBy("doc_id").orderBy(F.col("text").cast("string"))
    # A filter on row_number runs as a group limit before the shuffle: rows of one id aren't gathered.
    first = stay.join(twice, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return stay.join(twice, same, "left_anti").unionByName(first)
