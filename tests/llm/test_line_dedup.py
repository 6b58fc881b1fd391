import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm.line_dedup import LineDedupConfig, line_report, repeat_filter, without_repeated_lines
from scriptorium.llm.queries import oracle_sql, op6_line_dedup
from tests.llm.helpers import frame, lower


def brute(rows, chars=20, docs=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars and doc_id is not None:
                where[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(where.get(key(x), ())) < docs or doc_id == max(where[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


L = ["a line of more than twenty", "another line of that length", "exactly twenty chars", "nineteen characters", "É line with an accent in it"]
ROWS = [(1, None), (2, ""), (3, f"{L[0]}\n\n  {L[0].upper()}\t\n{L[1]}"), (4, f"{L[0]}\n{L[3]}\n{L[2]}\n"), (5, f"{L[2]}\r\n{L[3]}\n{L[0]}"), (6, f"{L[2]}\n{L[3]}\n{L[1]}"), (7, L[4]), (8, L[4]), (9, L[4].lower()), (10, L[4]), (10, L[4]), (None, L[0]), (None, L[1]), (12, (L[0] + "\n") * 5000)]


def test_against_brute_force(spark):
    got = sorted(map(tuple, line_report(frame(spark, ROWS)).collect()), key=str)
    assert got == sorted([x[:4] for x in brute(ROWS)], key=str)
    docs = frame(spark, ROWS)
    out = without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted([(x[0], x[4]) for x in brute(ROWS)], key=str)
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert line_report(frame(spark, [])).collect() == []


def test_clashing_names_and_a_line_of_every_document(spark):
    rows = [(d, f"the very same line in all of them\nown line number {d} of its document") for d in range(600)]
    docs = frame(spark, rows).withColumn("gone", F.lit(1)).withColumn("__drop", F.lit(2)).withColumn("drop_id", F.lit(3))
    out = without_repeated_lines(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.collect()) == sorted((x[0], x[4]) for x in brute(rows))


@pytest.mark.parametrize("log2", [16, 10])
def test_a_full_filter_changes_nothing(spark, log2):
    rng = random.Random(5)
    lines = [f"line {i} {'x' * rng.randrange(10, 30)}" for i in range(3000)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(12))) for d in range(800)]
    config = LineDedupConfig(max_log2_bits=max(16, log2)) if log2 == 16 else LineDedupConfig(max_log2_bits=10, blocks=4)
    assert sorted(map(tuple, line_report(frame(spark, rows), config).collect())) == sorted(x[:4] for x in brute(rows))


def test_filter_leaves_single_lines_out(spark):
    rows = [(d, f"this line is only in document {d}") for d in range(4000)]
    packed, _ = repeat_filter(frame(spark, rows).select("doc_id", "text"), LineDedupConfig())
    assert np.unpackbits(np.frombuffer(packed, np.uint8)).mean() < 0.2


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({oracle_sql()['op6_line_dedup']})").fetchall()
    assert sorted(map(tuple, op6_line_dedup(spark, sf).collect())) == sorted(want)
