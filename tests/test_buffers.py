import time

from scriptorium.streaming.buffers import ROCKSDB, BufferConfig, buffered

SCHEMA = "stream string, at int, op string, event_id long, data string, client string"


def run(spark, tmp_path, number, rows, config):
    """One micro-batch after the others, from the checkpoint; all outputs so far. (With timers of processing time, availableNow would go on for ever.)"""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = buffered(stream, config).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def emit(stream, *ids):
    return [(stream, i, "emit", i, f"d{i}", None) for i in ids]


def made(op, stream, *ids, client=None):
    return [(stream, op, client, i, f"d{i}") for i in ids]


def test_pause_drop_resume_and_reconnect_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        config = BufferConfig(queue=3, history=5, pause_ms=600_000)
        want = made("event", "a", 1, 2) + made("event", "b", 1)
        assert run(spark, tmp_path, 1, emit("a", 1, 2) + emit("b", 1) + [("a", 3, "pause", None, None, None), (None, 1, "emit", 9, "x", None)], config) == sorted(want)
        want += made("event", "b", 2) + made("dropped", "a", 4)
        assert run(spark, tmp_path, 2, emit("a", 4, 5, 6, 7) + emit("b", 2), config) == sorted(want)
        want += made("event", "a", 5, 6, 7, 9) + made("replayed", "a", 6, 7, client="c")
        rows = [("a", 8, "connect", 5, None, "c"), ("a", 8, "resume", None, None, None), *emit("a", 9)]
        assert run(spark, tmp_path, 3, rows, config) == sorted(want)
        want += made("replayed", "a", 4, 5, 6, 7, 9, client="new")
        assert run(spark, tmp_path, 4, [("a", 10, "connect", None, None, "new")], config) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_timer_ends_a_pause(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        config = BufferConfig(pause_ms=1)
        assert run(spark, tmp_path, 1, [("a", 0, "pause", None, None, None), *emit("a", 1, 2)], config) == []
        time.sleep(0.1)
        assert run(spark, tmp_path, 2, emit("b", 7), config) == made("event", "a", 1, 2) + made("event", "b", 7)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
