import hashlib

import duckdb

from scriptorium.llm import queries, vector_codes
from scriptorium.llm.vector_codes import VectorCodeConfig, compress

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row int"


def brute(rows, config=VectorCodeConfig()):
    """{(vec_id, label): (code, error, label_error)} and the digest, in Python integers."""
    import math

    kept = [(v, [math.floor(config.scale * c) for c in x], label) for v, x, label in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // config.parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    ids = sorted({v for v, _, _ in kept if v is not None})[: config.entries]
    first = {v: min(x for w, x, _ in kept if w == v) for v in ids}
    books = [[cut(first[v], p) for v in ids] for p in range(config.parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, c)), e) for e, c in enumerate(book))
    for _ in range(config.rounds):
        for p in range(config.parts):
            held = [[] for _ in books[p]]
            for _, x, _ in kept:
                held[near(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else old for h, old in zip(held, books[p])]
    out, sums = [], {}
    for v, x, label in kept:
        found = [near(cut(x, p), books[p]) for p in range(config.parts)]
        out.append((v, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        sums[label] = sums.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((v, code, error, sums[label]) for v, label, code, error in out), key=str), digest


def rows_of(spark, rows, config=VectorCodeConfig()):
    df = spark.createDataFrame([(*r, "z", 7) for r in rows], SCHEMA)
    return [tuple(r) for r in compress(df, config).collect()]


def test_odd_rows_against_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 7 + j * 3) % 11 - 5) / 7 for j in range(8)], i % 3) for i in range(40)]
    rows += [(50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [nan] + [0.0] * 7, 1), (53, [inf] + [0.0] * 7, None), (54, [-0.0001] * 8, None), (None, [0.25] * 8, None), (3, rows[3][1], 0), (3, [-9.0] * 8, None)]
    for config in (VectorCodeConfig(entries=8), VectorCodeConfig(entries=256), VectorCodeConfig(entries=3, rounds=0)):
        got = rows_of(spark, rows, config)
        want, digest = brute(rows, config)
        assert sorted((r[:4] for r in got), key=str) == want
        assert {r[4] for r in got} == {digest}


def test_rows_without_a_code(spark):
    rows = [(1, [0.5] * 4, 1), (2, [1.0] * 8, 1), (3, [1e30] * 4, None), (4, [], 2), (5, [5e5] * 4, 2)]
    got = {r[0]: r[1:4] for r in rows_of(spark, rows)}
    assert got[1] == ("00000000", 0, 0) and got[2] == (None, None, 0) and got[3] == (None, None, None) and got[4][:2] == (None, None)
    assert got[5][0] == "01010101"
    assert rows_of(spark, [(None, [1.0] * 4, 1)])[0][:4] == (None, None, None, None)
    assert rows_of(spark, [(7, None, 1)]) == [] and rows_of(spark, []) == []


def test_large_components_stay_exact(spark):
    most = vector_codes.largest_component(4) / 1024
    rows = [(1, [most * 0.9] * 4, 1), (2, [-most * 0.9] * 4, 1), (3, [most * 0.5] * 4, 2)]
    got = rows_of(spark, rows, VectorCodeConfig(entries=2))
    import numpy as np

    exact = [(v, [float(np.float32(c)) for c in x], label) for v, x, label in rows]
    want, digest = brute(exact, VectorCodeConfig(entries=2))
    assert sorted((r[:4] for r in got), key=str) == want and got[0][4] == digest


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op12_vector_codes(spark, sf)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(con.sql(queries.oracle_sql()["op12_vector_codes"]).select(*columns).fetchall(), key=str)
