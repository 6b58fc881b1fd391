from pyspark.sql import functions as F

from scriptorium.operators import enhance, layout, search
from scriptorium.plans import lockfile
from scriptorium.plans.regenerate import regenerate


def test_rewrites(spark):
    df = spark.createDataFrame([("## A\n#### x\n\n```\n1\n```", "## A\n## B \n\n```\n1\n```", "优化后的内容\n ## T\nbody")], "o string, r string, c string")
    row = df.select(
        enhance.guarded(F.col("o"), F.col("r")).alias("lost"), enhance.guarded(F.col("r"), F.col("o")).alias("kept"), enhance.cleaned(F.col("c")).alias("clean"),
        enhance.demoted(F.col("r"), enhance.chapters(F.col("o"))).alias("demoted"), enhance.without_thoughts(F.lit("< think >a\nb</think > c ")).alias("said"), enhance.escaped(F.lit("[a_b]")).alias("escaped"),
    ).first()
    assert row.lost == "## A\n#### x\n\n```\n1\n```" and row.kept == row.lost and row.clean == "body"
    assert row.demoted == "## A\n**B**\n\n```\n1\n```" and row.said == "c" and row.escaped == r"\[a\_b\]"


def test_ragged_tables(spark):
    texts = ["|a|b|\n|-|-|\n|1|", "|a|b|\n|-|-|\n|1|2|", "|a|b|\n|1|", "x\n" * 9 + "|a|\n|b|c|\nx\n|-|\n|d|", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, layout.ragged_tables(df).collect())) == [(0, 1, 2), (3, 10, 2)]


def test_check_counts(spark):
    df = spark.createDataFrame([(" \n",), ("# a\n## b\n# c",), ("# a\x01\n│",)], "text string")
    p0, p1 = layout.check_counts(F.col("text"))
    rows = df.select(p0.alias("p0"), p1.alias("p1"), layout.check_status(p0, p1).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "blocked"), (0, 0, "pass"), (0, 3, "fail")]


def test_engines_and_sites(spark):
    rows = spark.createDataFrame([("q", 1, "u", "a"), ("q", 0, "u", "b"), ("q", 2, "", "c"), ("q", 3, "v", "d"), ("q", 4, "w", "e")], "q string, k int, url string, source string")
    assert [r.source for r in search.merged(rows, "q", ["k"], 2).orderBy("k").collect()] == ["b", "d"]
    sites = spark.createDataFrame([("q", i, f"s{i}", "x", "S") for i in range(5)] + [("q", 9, "v", "x", "T")], "q string, k int, url string, source string, site string")
    got = search.with_sites(rows, sites, "q", ["k"], 10).collect()
    assert sorted((r.url, r.source) for r in got) == [("s0", "x[S]"), ("s1", "x[S]"), ("s2", "x[S]"), ("u", "b"), ("v", "d"), ("w", "e")]
    assert search.site_queries(rows.limit(1), "q").count() == len(search.SITES)


def test_lockfile(tmp_path):
    agents = {"a": {"version": "1", "config": {"y": 1, "x": 2}}, "b": {"version": "2", "dependencies": ["a"], "pool_size": 2}}
    locked = lockfile.lock("p", agents)
    assert locked["agents"]["a"]["config_hash"] == lockfile.config_hash({"x": 2, "y": 1}) and locked["node_count"] == 2
    lockfile.write(tmp_path / "p.lock", locked)
    assert lockfile.differences(locked, "p", agents) == [] and lockfile.differences(None, "p", agents) == [("", "missing lockfile")]
    assert lockfile.differences(locked, "q", {"a": {"version": "9"}, "c": {"version": "1"}}) == [("", "pipeline"), ("a", "version"), ("c", "not locked")]


def test_regenerate(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "a"), (3, ""), (4, None)], "doc_id long, text string")
    out = regenerate(df, lambda t: F.length(t), lambda d: d.withColumn("text", F.concat("text", F.lit("a"))), 2, 1).orderBy("doc_id").collect()
    assert [(r.text, r.generation, r.status) for r in out] == [("aaa", 0, "pass"), ("aa", 1, "pass"), ("a", 1, "accepted_with_warnings"), (None, 1, "accepted_with_warnings")]
