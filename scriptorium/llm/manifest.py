"""A Merkle manifest of a dataset: exact ranks by digit histograms, a trie of rank digits, proofs and their check.

Leaves of a language ascend by doc_id. Their ranks need no global sort: ids are counted by their
leading digits, level by level, and a group's rank is the sum of the counts of smaller digits on
each level; inside a group, which is small, rows are numbered. A group that repeated ids make large
is cut further, by digest and by row. The base-``fanout`` digits of the ranks key the nodes of the
trie: ``fanout ** levels`` leaves with the longest common prefix are reduced to one node by one
task, and so on with shorter prefixes up to the subroot, and over the subroots up to the root.
The way down hands every node the siblings on its way to the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise, salted_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class ManifestConfig:
    """fanout_bits: a node has 2^fanout_bits children at most. levels: of the trie that one group reduces. digit_bits: of ids, by level of the histograms.

    most: rows of a group of ids beyond which it is cut by digest and row.
    """

    fanout_bits: int = 3
    levels: int = 3
    digit_bits: int = 8
    most: int = 4096


def digest(*parts: Column) -> Column:
    """H: the lowercase hexadecimal SHA-256 of the parts' concatenated UTF-8."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value as text."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(**changed: Column) -> Column:
    return digest(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def tampered_leaf() -> Column:
    """The leaf with A-Z of the text lower-cased where 3 divides the id's CRC-32, else the leaf as it is."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, leaf_of(text=F.translate(F.col("text").cast("string"), UPPER, LOWER))).otherwise(leaf_of())


# -- ranks -------------------------------------------------------------------------------------


def bases(counts: DataFrame, fixed: list[str], digits: list[str]) -> DataFrame:
    """``counts`` (fixed, digits, n) with base: the rows before a group, among those with equal ``fixed``, in the order of ``digits``.

    Every window runs over the values of one digit below equal digits before it.
    """
    tables = [counts]
    for i in range(len(digits) - 1, 0, -1):
        tables.append(tables[-1].groupBy(*fixed, *digits[:i]).agg(F.sum("n").alias("n")))
    found = None
    for i, table in enumerate(reversed(tables)):
        above = [*fixed, *digits[:i]]
        before = Window.partitionBy(*above).orderBy(digits[i]).rowsBetween(Window.unboundedPreceding, -1)
        own = table.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if found is not None:
            own = own.join(found.select(*above, F.col("base").alias("over")), above).withColumn("base", F.col("base") + F.col("over"))
        found = own.select(*above, digits[i], "n", "base")
    return found


def id_levels(least: int, most: int, bits: int) -> int:
    """After how many further levels of digits ``least`` and ``most`` have the same prefix; values of both signs end as -1 and 0, two digits of a last level."""
    levels = 0
    while least != most:
        least, most, levels = least >> bits, most >> bits, levels + 1
        if (least, most) == (-1, 0):
            return levels + 1
    return levels


def ranked(leaves: DataFrame, sizes: DataFrame, config: ManifestConfig) -> DataFrame:
    """``leaves`` (trie, bucket, id, leaf, at, ...) with rank, from 0, within each trie by id, then leaf; ``sizes``: (trie, bucket, n) of the leaves."""
    ends = sizes.agg(F.min("bucket").alias("least"), F.max("bucket").alias("most")).first()
    prefixes = [f"p{k}" for k in range(id_levels(ends["least"], ends["most"], config.digit_bits) - 1, 0, -1)]
    counts = sizes.select("trie", *(F.shiftright("bucket", config.digit_bits * int(p[1:])).alias(p) for p in prefixes), "bucket", "n")
    start = materialise(bases(counts, ["trie"], [*prefixes, "bucket"]).select("trie", "bucket", "n", "base"), "bucket_bases")
    large = start.filter(F.col("n") > config.most).select(F.struct("trie", "bucket").alias("spot"), "n")

    def numbered(rows: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "leaf", "at"))
        return rows.withColumn("place", place).join(start.select(*keys, "base"), keys).withColumn("rank", F.col("base") + F.col("place") - 1).drop("place", "base")

    if large.isEmpty():
        return numbered(leaves, start, ["trie", "bucket"])
    rows = leaves.count()
    spotted = leaves.withColumn("spot", F.struct("trie", "bucket"))
    light = salted_join(spotted, large, "spot", "n", "at", rows, "left_anti").drop("spot")
    # Repeated ids (or rows without one): digits of the digest, the digest, and ranges of rows go on where the id's end.
    heavy = salted_join(spotted, large, "spot", "n", "at", rows, "left_semi").drop("spot")
    heavy = materialise(heavy.withColumn("head", F.left("leaf", F.lit(4))).withColumn("chunk", F.shiftright("at", 12)), "large_buckets")
    digits = ["id", "head", "leaf", "chunk"]
    own = bases(heavy.groupBy("trie", "bucket", *digits).agg(F.count(F.lit(1)).alias("n")), ["trie", "bucket"], digits)
    own = own.join(start.select("trie", "bucket", F.col("base").alias("over")), ["trie", "bucket"]).withColumn("base", F.col("base") + F.col("over"))
    own = materialise(own.select("trie", "bucket", *digits, "base"), "large_bases")
    return numbered(light, start, ["trie", "bucket"]).unionByName(numbered(heavy, own, ["trie", "bucket", *digits]).drop("head", "chunk"))


# -- the trie ----------------------------------------------------------------------------------


def _raised(nodes: Column, bits: int) -> Column:
    """The nodes above: of each run of 2^bits."""
    runs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, bits))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, F.shiftleft(i, bits) + 1, 1 << bits), ""), 256))


def climbed(nodes: DataFrame, carried: list[str], most: int, config: ManifestConfig) -> list[DataFrame]:
    """Tables of groups, from the leaves up to one group a trie: (trie, block, kids, l0, l1, ..., steps, top).

    ``nodes``: trie, rank, node and ``carried`` columns, which ``kids`` holds; ``most``: the nodes of the largest trie. A group
    holds fanout^levels nodes, so its list is bounded. Only a trie's first group may end early: it takes as many steps as
    its nodes need, none if there is one.
    """
    bits, levels = config.fanout_bits, config.levels
    tables, width = [], bits * levels
    while True:
        kid = F.struct("rank", "node", *carried)
        own = nodes.groupBy("trie", F.shiftright("rank", width).alias("block")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        own = own.withColumn("l0", F.transform("kids", lambda k: k["node"]))
        need = F.lit(0)
        for k in range(levels):
            need = need + (F.size("l0") > (1 << bits * k)).cast("int")
            own = own.withColumn(f"l{k + 1}", _raised(F.col(f"l{k}"), bits))
        own = own.withColumn("steps", F.when(F.col("block") == 0, need).otherwise(levels))
        top = F.element_at(F.element_at(F.array(*(f"l{k}" for k in range(levels + 1))), F.col("steps") + 1), 1)
        tables.append(materialise(own.withColumn("top", top).drop(f"l{levels}"), "trie"))
        most = -(-most >> width) if most >> width << width == most else (most >> width) + 1
        if most <= 1:
            return tables
        nodes, carried = tables[-1].select("trie", F.col("block").alias("rank"), F.col("top").alias("node")), []


def descended(tables: list[DataFrame], above: DataFrame, config: ManifestConfig) -> DataFrame:
    """(trie, subroot, kid, path) for each leaf of the trie: ``path`` has the siblings (before, after) of each level up to the root.

    ``above``: (trie, subroot, path) of the subroots.
    """
    bits, levels = config.fanout_bits, config.levels
    run = (1 << bits) - 1

    def siblings(place: Column, k: int) -> Column:
        at = F.shiftright(place, bits * k)
        start = F.shiftleft(F.shiftright(at, bits), bits)
        joined = lambda first, n: F.array_join(F.slice(f"l{k}", first, n), "")
        return F.when(F.col("steps") > k, F.struct(joined(start + 1, at - start).alias("before"), joined(at + 2, start + run - at).alias("after")))

    def path(kid: Column, place: Column) -> Column:
        own = F.filter(F.array(*(siblings(place, k) for k in range(levels))), lambda x: x.isNotNull())
        return F.struct(kid.alias("kid"), F.concat(own, F.col("path")).alias("path"))

    found = above.withColumn("block", F.lit(0).cast("long"))
    for i in range(len(tables) - 1, -1, -1):
        own = tables[i].join(found, ["trie", "block"])
        own = own.select("trie", "subroot", F.inline(F.transform("kids", path)))
        found = own.select("trie", F.col("kid.rank").alias("block"), "subroot", "path") if i else own
    return found


def manifest(docs: DataFrame, config: ManifestConfig = ManifestConfig()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs`` (FIELDS; other columns are ignored).

    Rows with a null doc_id come first in their language and aren't tampered with; rows of equal ids ascend by leaf, and equal rows
    (copies) have a place each; null texts and languages count as null, not as empty. A language with one row has its leaf as subroot, a table with
    one language its subroot as root. An empty table gives an empty table. The root doesn't depend on the order or the partitions of the rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in FIELDS[1:]))
    bits = config.digit_bits
    # Nulls first: a value below all ids' prefixes, and below all languages.
    bucket = F.coalesce(F.shiftright("doc_id", bits), F.lit(-(1 << 63 - bits) - 1).cast("long"))
    trie = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang")))
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), trie.alias("trie"), bucket.alias("bucket"), leaf_of().alias("leaf"), tampered_leaf().alias("tampered"), F.monotonically_increasing_id().alias("at"))
    # A table, so that ``at`` names the same row in every later stage.
    leaves = materialise(own, "leaves")
    sizes = materialise(leaves.groupBy("trie", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    tries = materialise(sizes.groupBy("trie").agg(F.sum("n").alias("size")), "tries")
    count = tries.agg(F.count(F.lit(1)).alias("tries"), F.max("size").alias("most")).first()
    if not count["tries"]:
        return docs.sparkSession.createDataFrame([], RESULT)
    nodes = ranked(leaves, sizes, config).select("trie", "rank", F.col("leaf").alias("node"), "doc_id", "tampered")
    tables = climbed(nodes, ["doc_id", "tampered"], count["most"], config)
    # Languages by their leading bytes, then as a whole.
    places = bases(tries.select(F.substring(F.encode("trie", "UTF-8"), 1, 3).alias("head"), "trie", F.lit(1).cast("long").alias("n")), [], ["head", "trie"])
    tops = tables[-1].select(F.col("trie").alias("of"), F.col("top").alias("node")).join(places.select(F.col("trie").alias("of"), F.col("base").alias("rank")), "of")
    upper = climbed(tops.withColumn("trie", F.lit("")), ["of"], count["tries"], config)
    root = upper[-1].first()["top"]
    start = docs.sparkSession.createDataFrame([("", root, [])], "trie string, subroot string, path array<struct<before: string, after: string>>")
    above = descended(upper, start, config).select(F.col("kid.of").alias("trie"), F.col("kid.node").alias("subroot"), "path")
    found = descended(tables, materialise(above, "root_paths"), config)
    proof = digest(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""))
    folded = F.aggregate("path", F.col("kid.tampered"), lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))
    found = found.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.node").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
