"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Rows are dealt by conversation and sorted inside each partition; the machine then runs over the
stream of turns, so memory is that of one turn however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``start + role + middle + text + stop``; ``trained`` roles have their text under the loss mask.

    Control strings begin with ``mark``. In roles and texts ``mark`` is written ``mark + mark[-1]``,
    so no control string can arise there and undoing it is one replacement.
    ``order`` gives, for each state (the role before, "" at the start), the roles that may follow.
    """

    start: str = "<|im_start|>"
    middle: str = "\n"
    stop: str = "<|im_end|>\n"
    mark: str = "<|"
    trained: frozenset[str] = frozenset({"assistant"})
    order: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})

    def escape(self, text: str) -> str:
        return text.replace(self.mark, self.mark + self.mark[-1])

    def unescape(self, text: str) -> str:
        return text.replace(self.mark + self.mark[-1], self.mark)

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", f"{self.mark}nl|>")

    def unescape_role(self, role: str) -> str:
        return self.unescape(role.replace(f"{self.mark}nl|>", "\n"))


SEGMENTS = "conv_id long, turn long, part int, segment string, loss boolean, valid boolean"
_NAMES = ["conv_id", "turn", "part", "segment", "loss", "valid"]


def format_segments(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, turn, part, segment, loss, valid): joined in order, the segments of a conversation are its formatted text.

    Each turn gives part 0 (markup with the role), 1 (the escaped text; loss = true for trained
    roles) and 2 (the closing markup). valid says whether the machine accepts the turn after the
    one before; an unknown or null role is not accepted, written all the same, and the machine goes
    on from it. Null texts and roles count as empty. Turns are ordered by turn (null first), then
    role and text, which settles ties; repeated rows are turns of their own. Columns other than
    conv_id, turn, role and text are ignored. Inside a partition, rows come out in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seen = None, "", False
        for batch in batches:
            out: list[list] = [[] for _ in _NAMES]
            for conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if not seen or conv_id != last:
                    last, state, seen = conv_id, "", True
                valid, state = role in template.order.get(state, ()), role
                for part, (segment, loss) in enumerate(((template.start + template.escape_role(role) + template.middle, False), (template.escape(text), role in template.trained), (template.stop, False))):
                    for column, value in zip(out, (conv_id, turn, part, segment, loss, valid), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=_NAMES)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


class _Reader:
    """Reads a conversation back from its formatted text, fed segment by segment."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template, self.buffer = template, ""
        self.turns, self.all, self.loss = 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0
        self.valid = True

    def feed(self, segment: str, loss: bool, valid: bool) -> None:
        t = self.template
        self.chars += len(segment)
        self.valid &= valid
        if loss:
            plain = t.unescape(segment)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(plain)
        self.buffer += segment
        if segment != t.stop:
            return
        # A stop string that stands in the buffer is markup: texts can't hold one.
        while (stop := self.buffer.find(t.stop)) >= 0:
            turn, self.buffer = self.buffer[:stop], self.buffer[stop + len(t.stop) :]
            if not turn.startswith(t.start):
                raise ValueError("formatted text does not start a turn where one is due")
            role, _, text = turn[len(t.start) :].partition(t.middle)
            self.all.update(f"{t.unescape_role(role)}\n{t.unescape(text)}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation, what its formatted text says: turns and texts parsed and unescaped, and what the loss mask covers.

    ``segments`` must come straight from format_segments, whose partitions hold whole conversations in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader = None, None

        def row() -> tuple:
            if reader.buffer:
                raise ValueError("formatted text ends inside a turn")
            return last, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, reader.valid

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            rows = []
            for conv_id, segment, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "valid")), strict=True):
                if reader is None or conv_id != last:
                    if reader is not None:
                        rows.append(row())
                    last, reader = conv_id, _Reader(template)
                reader.feed(segment, loss, valid)
            if rows:
                yield batch_of(rows)
        if reader is not None:
            yield batch_of([row()])

    return segments.mapInArrow(run, DIGEST)
