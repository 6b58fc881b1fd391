import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm.common import components, salted_join
from scriptorium.llm.near_dup import NearDupConfig, band_keys, first_of_each, near_duplicates, one_permutation_signature
from scriptorium.llm.queries import op2_near_duplicates
from tests.llm.helpers import brute_components, frame, shingles, table


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute_components(rows, 85)
    got = {r.doc_id: r for r in op2_near_duplicates(spark, sf).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(text)), want[doc_id], want[doc_id] == doc_id)


def variants(seed=3):
    """Chains of edits, so that members of a group are often unlike its smallest id, and shared passages that link nothing."""
    rng, rows, doc_id = random.Random(seed), [], 100
    vocabulary = [f"w{i}" for i in range(900)]
    for _ in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(14):
            text = list(text)
            for _ in range(max(1, len(text) // 90)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((doc_id, " ".join(text)))
            doc_id += rng.choice((1, 7, -3)) if doc_id > 110 else 11
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for i in range(30):
        rows.append((5000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))))
    rng.shuffle(rows)
    seen = {}
    return [(d, t) for d, t in rows if seen.setdefault(d, t) == t]


def test_no_link_is_lost_behind_a_hub(spark):
    rows = variants()
    want = brute_components(rows, 80)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), NearDupConfig(percent=80)).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "x " * 30_000), (8, "x " * 30_001), (9, "a b c d e f"), (9, "a b c d e f"), (None, "one two"), (10, "É b"), (11, "é b")]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 2, 9, True), (9, 2, 9, True), (None, 1, 4, False), (10, 1, 10, True), (11, 1, 11, True)], key=str)
    assert near_duplicates(frame(spark, [])).collect() == []


def test_stage_keeps_one_of_each_with_all_columns(spark):
    docs = frame(spark, [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words here"), (4, None)])
    kept = first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_agreement_follows_jaccard():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    other = np.unique(np.concatenate((base[:900], rng.integers(0, 2**63, 100).astype(np.uint64))))
    a, b = one_permutation_signature(base, 216), one_permutation_signature(other, 216)
    assert abs((a == b).mean() - 900 / 1100) < 0.1
    assert len(band_keys(a, 36, 6)) == 36
    assert (one_permutation_signature(base[:1], 216) == base[0]).all()


def test_texts_under_one_id_are_one_node(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (7, x + " tail"), (8, y + " tail"), (3, z), (9, z), (9, "quite another text of some words"), (9, ""), (11, "Quite another text  of some words")]
    want = brute_components(rows, 80)
    assert want[7] == want[8] == 5 and want[11] == 3
    for n, order in ((1, rows), (2, rows[::-1]), (3, rows), (4, rows[::-1])):
        got = near_duplicates(frame(spark, order).repartition(n), NearDupConfig(percent=80)).collect()
        assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_stage_keeps_null_ids_and_one_row_of_each_group(spark):
    x = " ".join(f"x{i}" for i in range(60))
    docs = frame(spark, [(5, x), (5, x + " b"), (5, x), (6, x + " tail"), (None, x), (None, None), (7, "other words"), (7, "other words")]).withColumn("group_id", F.lit(1)).withColumn("__kept_id", F.lit(2))
    kept = first_of_each(docs, NearDupConfig(percent=80))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, x), (None, x), (None, None), (7, "other words")], key=str)


def test_a_large_group_of_copies_and_of_near_copies(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(i, x) for i in range(1, 400)] + [(1000 + i, f"{y} t{i}") for i in range(400)]
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), NearDupConfig(percent=80)).collect()} == {d: 1 if d < 1000 else 1000 for d, _ in rows}


def test_salted_join_and_components_with_a_hub(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = salted_join(left, right, "k", "n", "id", 3000)
    assert got.columns == ["k", "id", "least"] and {(r.id, r.least) for r in got.collect()} == {(i, 0 if i < 2000 else i) for i in range(3000)} and got.count() == 3000
    assert salted_join(left, right.filter("k = 7"), "k", "n", "id", 3000, "left").filter("least IS NULL").count() == 1000
    edges = spark.range(1000).select(F.lit(2000).alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(5000, 2000), (6001, 6000)], "a long, b long"))
    assert {(r.node, r.label) for r in components(edges, "a", "b").collect()} == {(i, 0) for i in [*range(1000), 2000, 5000]} | {(6000, 6000), (6001, 6000)}
