import hashlib
import random
import zlib

import duckdb

from scriptorium.llm import queries
from scriptorium.llm.manifest import ManifestConfig, manifest

from .helpers import lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, node string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout):
    """(top, ways): for each node the siblings (before, behind) by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place // fanout * fanout
            ways[i].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + fanout])))
            at[i] = place // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows, fanout=8):
    """All result rows, by recursion over lists."""
    langs = {}
    for row in rows:
        doc_id, text, lang, source, n_chars = row
        bad = text if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 else lower(text)
        langs.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf(*row)), doc_id, leaf(*row), leaf(doc_id, bad, lang, source, n_chars)))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    tops = {name: tree([x[2] for x in sorted(langs[name], key=lambda x: x[0])], fanout) for name in names}
    root, above = tree([tops[n][0] for n in names], fanout)
    out = []
    for name, upper in zip(names, above):
        for (_, doc_id, own, bad), way in zip(sorted(langs[name], key=lambda x: x[0]), tops[name][1]):
            for before, behind in way + upper:
                bad = h(before, bad, behind)
            out.append((doc_id, own, tops[name][0], root, h(*(b + a for b, a in way + upper)), bad, bad == root))
    return sorted(out, key=str)


def check(spark, rows, config=ManifestConfig(), partitions=3):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(partitions)
    got = sorted(map(tuple, manifest(df, config).collect()), key=str)
    assert got == brute(rows, 1 << config.fanout_bits)
    return got


def made(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(-5000, 5000) if rng.random() < 0.9 else rng.choice((None, -(1 << 63), (1 << 63) - 1)), rng.choice((None, "", "Ab\n", "ÄÖ x", "lower")), rng.choice(langs), rng.choice((None, "s")), rng.choice((None, 3))) for _ in range(n)]


def test_odd_rows_against_brute_force(spark):
    rows = made(700, ("en", None, "", "é", "zh", "e", "en-x")) + [(5, "Q", "solo", None, 1)]
    rows += rows[:40] * 3
    got = check(spark, rows)
    assert not all(r[6] for r in got) and any(r[6] for r in got)


def test_repeated_ids_are_cut_further(spark):
    rows = [(7, f"T{i % 50}", "en", None, i % 2) for i in range(400)] + [(None, "N", "en", None, None)] * 90 + [(i, "x", "en", "s", 1) for i in range(30)]
    check(spark, rows, ManifestConfig(most=20))


def test_shapes_of_the_trie(spark):
    for n in (1, 2, 8, 9, 64, 65):
        check(spark, [(i, "A", "en", None, 1) for i in range(n)], ManifestConfig(levels=1))
    check(spark, [(i, "A", f"l{i % 20}", None, 1) for i in range(70)], ManifestConfig(fanout_bits=1, levels=2, digit_bits=3))
    check(spark, [(i << 40, "A", "en", None, 1) for i in range(-5, 5)])


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op13_manifest(spark, sf)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(con.sql(queries.oracle_sql()["op13_manifest"]).select(*columns).fetchall(), key=str)
