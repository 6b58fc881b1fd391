import hashlib

import numpy as np

from scriptorium.llm.fingerprint import digits, fingerprints, least_values, likeness, similarity_classes
from scriptorium.llm.common import shingle_set
from scriptorium.llm.queries import op5_fingerprints, op5_similar_documents
from tests.llm.helpers import brute_components, frame, shingles, table


def expect(rows):
    """By the contract, every text fingerprinted whole."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    mark = lambda t: digits(least_values(shingle_set(t), 128))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = mark(text), mark(edited), mark(following)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, op5_fingerprints(spark, sf).collect()), key=str) == expect(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "é" * 9), (None, "some words without id"), (4, "w " * 60_000), (50, "one two three four five six seven"), (-7, "abc def")]
    assert sorted(map(tuple, fingerprints(frame(spark, rows)).collect()), key=str) == expect(rows)
    assert fingerprints(frame(spark, [])).collect() == []
    assert sorted(map(tuple, fingerprints(frame(spark, [(5, "only one text here, alone")])).collect())) == expect([(5, "only one text here, alone")])


def test_likeness_estimates_jaccard():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"v{i}" for i in range(100))
    s, t = shingles(a), shingles(b)
    assert abs(likeness(digits(least_values(shingle_set(a), 128)), digits(least_values(shingle_set(b), 128))) - len(s & t) / len(s | t)) < 0.13
    assert (least_values(np.empty(0, np.uint64), 4) == np.uint64(2**64 - 1)).all()


def test_similar_documents(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:199] + ["x"])), (4, " ".join(base[:100] + ["y"] * 100)), (5, None), (6, "")]
    assert {r.doc_id: r.class_id for r in similarity_classes(frame(spark, rows)).collect()} == brute_components(rows, 80) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_classes_find_links_between_two_others_of_a_band(spark):
    base = [f"w{i}" for i in range(300)]
    # Each of 150 small ids lacks 66 words in a row; of the four values of any band that 201 and 202 share, some id has all.
    rows = [(i, " ".join(w for at, w in enumerate(base[:293]) if (at - 2 * i) % 300 >= 66)) for i in range(1, 151)]
    rows += [(201, " ".join([*base[:295], "x"])), (202, " ".join([*base[:293], "y"])), (203, " ".join([*base[:295], "x"])), (204, ""), (205, None)]
    got = {r.doc_id: r.class_id for r in similarity_classes(frame(spark, [*rows, (None, "no id")])).collect()}
    assert got.pop(None) is None and got == brute_components(rows, 80) and got[202] == got[203] == 201


def test_similar_documents_of_the_table(spark, sf):
    """All links of all pairs are found: recall 1 on this table."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {r.doc_id: r.class_id for r in op5_similar_documents(spark, sf).collect()} == brute_components(rows, 80)
