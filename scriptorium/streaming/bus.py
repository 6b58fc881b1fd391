"""A message bus on Structured Streaming: micro-batches to subscribers by priority, failures to a table of dead letters, replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.tables import stored

Handler = Callable[[DataFrame], DataFrame]
LETTERS = "msg_id string, topic string, payload string, subscriber string, replay_count int"
OUTCOMES = "msg_id string, subscriber string, replay_count int, failed boolean"


class Bus:
    """Messages (msg_id, topic, payload) of a stream to handlers.

    A handler gets its topic's messages of a micro-batch as a DataFrame and returns those that failed (msg_id); handlers of a topic run by
    priority, smaller first, then by name. A handler that raises fails for the whole batch. Delivered ids and dead letters are tables below ``folder``; a batch
    that is run again after a crash replaces its own part, so that nothing counts twice.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.handlers: list[tuple[str, int, str, Handler]] = []

    def subscribe(self, topic: str, name: str, handler: Handler, priority: int = 100) -> None:
        self.handlers = sorted([*self.handlers, (topic, priority, name, handler)], key=lambda h: h[:3])

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Deliver what is there, in micro-batches, and stop."""
        return stream.writeStream.foreachBatch(self.deliver).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def deliver(self, batch: DataFrame, number: int) -> None:
        batch = batch.select("msg_id", "topic", "payload").dropDuplicates(["msg_id"])
        batch.write.mode("overwrite").parquet(f"{self.folder}/delivered/batch={number}")
        batch = self.spark.read.parquet(f"{self.folder}/delivered/batch={number}")
        for topic, _, name, handler in self.handlers:
            own = batch.filter(F.col("topic") == topic)
            letter = lambda rows: rows.select("msg_id", "topic", "payload", F.lit(name).alias("subscriber"), F.lit(0).alias("replay_count"))  # noqa: B023, E731
            place = f"{self.folder}/letters/batch={number}/part={name}"
            try:
                letter(own.join(handler(own).select("msg_id").distinct(), "msg_id", "left_semi")).write.mode("overwrite").parquet(place)
            except Exception:
                letter(own).write.mode("overwrite").parquet(place)

    def delivered(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/delivered")

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.folder}/{folder}")
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], schema)
        return found.select(*(x.split()[0] for x in schema.split(", ")))

    def letters(self) -> DataFrame:
        """One row for each message and subscriber that failed and hasn't been replayed with success since, with the number of its replays."""
        outcomes = self._read("replays", OUTCOMES).groupBy("msg_id", "subscriber").agg(F.max("replay_count").alias("replays"), F.bool_and("failed").alias("open"))
        own = self._read("letters", LETTERS).join(outcomes, ["msg_id", "subscriber"], "left").filter(F.coalesce("open", F.lit(True)))
        return own.select("msg_id", "topic", "payload", "subscriber", F.coalesce("replays", "replay_count").alias("replay_count"))

    def replay(self, most: int | None = None) -> DataFrame:
        """Hand each dead letter, with fewer than ``most`` replays so far if given, to its subscriber again; those that are left.

        The outcomes are a table of their own: a letter that succeeds is settled, one that fails comes with its count raised next time. A
        replay that breaks off is as if it had not been, but for what its handlers have done.
        """
        done = self._read("replays", f"{OUTCOMES}, number int")
        number = (done.agg(F.max("number")).first()[0] or 0) + 1
        letters = self.letters() if most is None else self.letters().filter(F.col("replay_count") < most)
        parts = []
        for i, (topic, _, name, handler) in enumerate(self.handlers):
            own = letters.filter((F.col("topic") == topic) & (F.col("subscriber") == name))
            try:
                failed = handler(own.select("msg_id", "topic", "payload")).select("msg_id").distinct().withColumn("failed", F.lit(True))
                outcome = own.join(failed, "msg_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
                parts.append(self._outcome(outcome, f"{number}-{i}"))
            except Exception:
                parts.append(self._outcome(own.withColumn("failed", F.lit(True)), f"{number}-{i}"))
        for i, part in enumerate(parts):
            part.write.mode("overwrite").parquet(f"{self.folder}/replays/number={number}/part={i}")
        return self.letters()

    def _outcome(self, rows: DataFrame, label: str) -> DataFrame:
        return stored(rows.select("msg_id", "subscriber", (F.col("replay_count") + 1).alias("replay_count"), "failed"), f"replay-{label}")
