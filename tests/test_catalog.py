import duckdb
import pytest

from scriptorium import catalog

TABLES = ("documents", "pages", "events", "conversations", "labels")


def plain(rows):
    return sorted((tuple(float(x) if hasattr(x, "as_tuple") else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


#: Beginnings of lines that regex engines read differently.
ODD = ["Testüber alles", "test的 more of it", "testé", "teſt words", "TEST", "test_it now", "Tester words", "\u3000test words\u00a0", "\u00a0abcd \t", "\t  ", "用于验证 x", "ab\n", "abc \u2028", "\x0b\x0b\x0b\x0b", " \u0085 aa ", "# no", "\u3000\u3000"]


def of_odd_texts(spark, name, table, rows, folder):
    rows.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    return plain(got.select(*sorted(got.columns)).collect()), plain(con.sql(catalog.oracle_sql()[name]).select(*sorted(got.columns)).fetchall())


def test_query_clean_on_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate([*ODD, None])], "conv_id long, turn int, role string, text string")
    got, want = of_odd_texts(spark, "query_clean", "conversations", rows, tmp_path)
    assert got == want and len(got) > 3


def test_query_scan_on_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate([*ODD, "\n".join(ODD), None])), "doc_id long, text string")
    got, want = of_odd_texts(spark, "query_scan", "documents", rows, tmp_path)
    assert got == want and any(r[1] is None for r in got)
