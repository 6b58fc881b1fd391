from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm.mixing import MixConfig, mix, mix_report, sainte_lague, targets
from scriptorium.llm.queries import op10_mixing
from tests.llm.helpers import frame, table, words


def by_quotients(votes, caps, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        i = max((i for i in range(len(votes)) if given[i] < caps[i]), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


def test_seats_go_to_the_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = rng.integers(1, 9)
        votes, caps = rng.integers(1, 1000, n), rng.integers(0, 60, n)
        seats = int(rng.integers(0, caps.sum() + 1))
        assert sainte_lague(votes, caps, seats).tolist() == by_quotients(votes.tolist(), caps.tolist(), seats)
    assert sainte_lague(np.array([53000, 24000, 23000]), np.array([99] * 3), 7).tolist() == [3, 2, 2]
    assert sainte_lague(np.array([]), np.array([]), 5).tolist() == [] and sainte_lague(np.array([0, 0]), np.array([0, 0]), 5).tolist() == [0, 0]


def filled(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = percent / 100 * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows, again = op10_mixing(spark, sf).collect(), op10_mixing(spark, sf).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    sizes, taken = {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = filled(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - r.target) <= max(64, 0.01 * r.target)


def test_odd_rows_and_shards(spark):
    rows = [(i, "w " * (i % 40), "en", ("a", "b", None, "é")[i % 4]) for i in range(400)] + [(7, None, "en", "a"), (None, "x y", "en", "b"), (8, "", "en", "empty"), (9, "long " * 40_000, "en", "z"), (3, "w " * 3, "en", "é"), (3, "w " * 3, "en", "é")]
    config = MixConfig(shard_docs=20)
    docs = frame(spark, rows)
    got = mix_report(docs, config).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = filled(sizes)
    assert sum(r.taken for r in got) == pytest.approx(sum(want.values()), rel=0.02)
    out = mix(docs, config)
    assert out.columns == docs.columns
    mixed = out.collect()
    assert all(r.n_chars == len(r.text) for r in mixed if r.text is not None)
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in got)
    assert mix_report(frame(spark, [])).collect() == [] and mix(frame(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in mix_report(frame(spark, [(1, None, "en", None)])).collect()] == [(0, 0, 0.0, 0)]


def test_rows_alike_have_a_plan_each(spark):
    rows = [(5, "w " * 100, "en", ("a", "b")[i % 2]) for i in range(30)] + [(i, "x " * 50, "en", "c") for i in range(9)]
    docs = frame(spark, rows).withColumn("mix_plan", F.lit(1)).withColumn("__key", F.lit(2))
    report, out = mix_report(docs, MixConfig(block=16)).collect(), mix(docs, MixConfig(block=16))
    assert out.columns == docs.columns
    taken, mixed = Counter(), Counter()
    for r in report:
        taken[r.doc_id, r.source_size] += r.taken
    size = {"a": 1500, "b": 1500, "c": 450}
    for r in out.collect():
        mixed[r.doc_id, size[r.source]] += len(words(r.text))
    assert mixed == +taken


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{i:02d}": int(x) for i, x in enumerate(rng.integers(1, 5000, 30))} | {None: 70, "t": 0}
    got = targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()
    want = filled(sizes)
    assert {r.source: r.target for r in got} == {s: pytest.approx(t, rel=1e-9) for s, t in want.items()}
