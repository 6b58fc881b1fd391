import datetime as dt

import pytest

from scriptorium.plans.dag import Node, expand_pools, levels
from scriptorium.streaming import control

START = dt.datetime(2024, 1, 1)


def events(spark, seconds, success=None):
    rows = [(i, "k", START + dt.timedelta(seconds=s), success[i] if success else True) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, ok boolean")


def test_token_bucket(spark):
    out = control.token_bucket(events(spark, [0, 0, 0, 1, 1, 5]), "key", "ts", ["ts", "id"], rate=1, burst=2).orderBy("id").collect()
    assert [r.allowed for r in out] == [True, True, False, True, False, True]


def test_circuit_breaker(spark):
    ok = [False, False, True, True, False, True]
    out = control.circuit_breaker(events(spark, [0, 1, 2, 70, 71, 72], ok), "key", "ts", ["ts", "id"], "ok", 2, 60).orderBy("id").collect()
    assert [(r.state, r.admitted) for r in out] == [("closed", True), ("open", True), ("open", False), ("closed", True), ("closed", True), ("closed", True)]


def test_first_of_key_in_batch_and_stream(spark, tmp_path):
    rows = [(i, k, START + dt.timedelta(seconds=i), True) for i, k in enumerate(["a", "b", "a", "c", "b", "a"])]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, ok boolean")
    assert [r.id for r in control.first_of_key(df, "key", ["id"]).orderBy("id").collect()] == [0, 1, 3]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = control.stream_first_of_key(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "ts", "1 hour")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_plans():
    nodes = expand_pools([Node("a", pool_size=2), Node("b", ("a",)), Node("c", ("a", "b"))])
    assert levels(nodes) == [["a_pool_0", "a_pool_1"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="cycle"):
        levels([Node("a", ("b",)), Node("b", ("a",))])
    with pytest.raises(ValueError, match="unknown"):
        levels([Node("a", ("x",))])
