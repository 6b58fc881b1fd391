"""Buffers of event streams with state of their own kinds: a bounded queue, a bounded history, a pause that a timer ends.

Rows of ``op``: ``emit`` puts an event into its stream's queue; ``pause`` holds the queue back, ``resume`` lets it out; ``connect`` asks for what came
behind ``event_id``. While a stream isn't paused its events come out at once. A full queue drops its oldest
event. Each kind of state is a list or a value in the state store, not one pickled object, and goes after a time without use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators.monitor import HISTORY, QUEUE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("data", T.StringType())])
OUTPUT = T.StructType([T.StructField("stream", T.StringType()), T.StructField("op", T.StringType()), T.StructField("client", T.StringType()), *EVENT.fields])
_OUT = Row(*OUTPUT.names)


@dataclass(frozen=True)
class BufferConfig:
    """queue: events that a paused stream holds; history: events that a client can ask for again; pause_ms: longest pause; unused_ms: how long state stays without use."""

    queue: int = QUEUE
    history: int = HISTORY
    pause_ms: int = 60_000
    unused_ms: int = 3_600_000


class Buffer(StatefulProcessor):
    """Outputs: (stream, op, client, event_id, data), op being ``event``, ``dropped`` or ``replayed``."""

    def __init__(self, config: BufferConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT, self.config.unused_ms)
        self.past = handle.getListState("past", EVENT, self.config.unused_ms)
        self.paused = handle.getValueState("paused", T.StructType([T.StructField("until_ms", T.LongType())]), self.config.unused_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (stream,) = key
        waiting, past = [tuple(x) for x in self.waiting.get()], [tuple(x) for x in self.past.get()]
        paused, was = self.paused.exists(), self.paused.exists()
        out: list[tuple] = []
        for row in sorted(rows, key=lambda r: r.at):
            if row.op == "emit":
                waiting.append((row.event_id, row.data))
                past.append((row.event_id, row.data))
                del past[: -self.config.history]
                if len(waiting) > self.config.queue:
                    out.append((stream, "dropped", None, *waiting.pop(0)))
            elif row.op == "connect":
                out += [(stream, "replayed", row.client, *x) for x in past if row.event_id is None or x[0] > row.event_id]
            else:
                paused = row.op == "pause" if row.op in ("pause", "resume") else paused
            if not paused:
                out += [(stream, "event", None, *x) for x in waiting]
                waiting.clear()
        self._keep(self.waiting, waiting)
        self._keep(self.past, past)
        if paused and not was:
            until = timerValues.getCurrentProcessingTimeInMs() + self.config.pause_ms
            self.paused.update((until,))
            self.handle.registerTimer(until)
        elif was and not paused:
            self._end_pause()
        return iter([_OUT(*x) for x in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A pause that nobody has ended ends."""
        (stream,) = key
        waiting = [tuple(x) for x in self.waiting.get()]
        self.waiting.clear()
        self.paused.clear()
        return iter([_OUT(stream, "event", None, *x) for x in waiting])

    def _end_pause(self) -> None:
        (until,) = self.paused.get()
        self.paused.clear()
        self.handle.deleteTimer(until)

    @staticmethod
    def _keep(state, events: list[tuple]) -> None:
        state.put(events) if events else state.clear()

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, config: BufferConfig = BufferConfig()) -> DataFrame:
    """The outputs of a stream of ``rows`` (stream string, at, op, event_id long, data string, client string), those of a micro-batch by ``at``.

    The session's state store must be RocksDB (``ROCKSDB`` in spark.sql.streaming.stateStore.providerClass). State of a stream: at most ``queue`` and
    ``history`` events; a micro-batch holds a stream's own rows.
    """
    own = rows.select("stream", "at", "op", "event_id", "data", "client").filter("stream IS NOT NULL")
    return own.groupBy("stream").transformWithState(statefulProcessor=Buffer(config), outputStructType=OUTPUT, outputMode="append", timeMode="ProcessingTime")
