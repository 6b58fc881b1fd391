"""Packing into fixed windows: bounded-space online best fit.

A task keeps a fixed number of open windows. A document fills whole windows first; what is left
of it goes to the open window that it fits best. When none fits, the fullest window is topped up
with the head of the piece and emitted full, and the rest opens a new one. At the end of a
partition its open windows merge; less than one window is left. These leftovers of many partitions
meet in groups of bounded size and merge once more; the last tokens of a group are cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise, small_batches


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class PackConfig:
    """vocabulary: file of the tokenizer, at the same path on every executor (None: word_bpe_49k.json of public_tokenizers).

    window: tokens of a sequence. end: id behind each document. spaces: open windows of a task.
    leftovers: partitions whose leftovers one task merges. cached: words whose ids a worker keeps.
    """

    vocabulary: str | None = None
    window: int = 4096
    end: int = 2
    spaces: int = 16
    leftovers: int = 64
    cached: int = 600_000


# -- ids ---------------------------------------------------------------------------------------

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\x00-\xff]*")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts, equal to the tokenizer's own, by ids of white-space separated words that are kept for reuse.

    The vocabulary's normaliser and pre-tokenizer never join text across white space, so a text's
    ids are those of its words. Latin-1 words skip the normaliser (lower-casing and NFC are trivial
    there); others go through the whole tokenizer, as does a text with U+001C to U+001F, which
    Python but not the tokenizer takes for white space.
    """

    def __init__(self, path: str, cached: int) -> None:
        from tokenizers import Tokenizer

        self.whole, self.cached = Tokenizer.from_file(path), cached
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            ids, tokenize = [], self.whole.model.tokenize
            for piece in _PIECES.findall(word.lower()):
                ids += [t.id for t in tokenize(piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode())))]
        else:
            ids = self._ids(word)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _ODD_SPACE.search(text):
            return np.array(self._ids(text), "<u4").tobytes()
        words, known = text.split(), self.known
        if len(known) > self.cached:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
        return b"".join([known[w] for w in words])


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(config: PackConfig) -> Callable[[str], bytes]:
    """The encoder of this Python worker; its kept words serve later tasks too."""
    key = config.vocabulary or public_vocabulary(), config.cached
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


# -- windows -----------------------------------------------------------------------------------

#: doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, bytes, int]
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "task"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
_ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long"


class Packer:
    """Open windows of one task. Sequences get ids from ``first_id`` on."""

    def __init__(self, window: int, spaces: int, first_id: int) -> None:
        self.window, self.spaces, self.next_id = window, spaces, first_id
        self.open: list[tuple[int, list[Piece]]] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), tokens, self.next_id, at, None, None))
            at += n
        self.next_id += 1

    def add(self, piece: Piece) -> None:
        doc_id, start, ids, tokens = piece
        while len(ids) >= 4 * self.window:
            self.emit([(doc_id, start, ids[: 4 * self.window], tokens)])
            start, ids = start + self.window, ids[4 * self.window :]
        if not ids:
            return
        n = len(ids) // 4
        fitting = [i for i, (used, _) in enumerate(self.open) if used + n <= self.window]
        if fitting:
            i = max(fitting, key=lambda i: self.open[i][0])
            used, held = self.open[i]
            held.append((doc_id, start, ids, tokens))
            self.open[i] = (used + n, held)
            if used + n == self.window:
                self.emit(self.open.pop(i)[1])
            return
        if len(self.open) == self.spaces:
            used, held = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            room = self.window - used
            self.emit([*held, (doc_id, start, ids[: 4 * room], tokens)])
            start, ids = start + room, ids[4 * room :]
            n -= room
        self.open.append((n, [(doc_id, start, ids, tokens)]))

    def merge(self) -> list[Piece]:
        """Emit full windows from what is open, fullest first; the pieces that are left hold less than a window."""
        pieces = [p for _, held in sorted(self.open, key=lambda x: -x[0]) for p in held]
        self.open = []
        while sum(len(p[2]) for p in pieces) >= 4 * self.window:
            taken, pieces = self.cut(pieces, self.window)
            self.emit(taken)
        return pieces

    @staticmethod
    def cut(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
        taken, room = [], 4 * tokens
        for i, (doc_id, start, ids, of) in enumerate(pieces):
            if len(ids) > room:
                head = [(doc_id, start, ids[:room], of)] if room else []
                return [*taken, *head], [(doc_id, start + room // 4, ids[room:], of), *pieces[i + 1 :]]
            taken.append(pieces[i])
            room -= len(ids)
        return taken, []

    def finish(self, pieces: list[Piece]) -> None:
        """Emit less than a window as sequences of powers of two, the largest first."""
        while left := sum(len(p[2]) for p in pieces) // 4:
            taken, pieces = self.cut(pieces, 1 << (left.bit_length() - 1))
            self.emit(taken)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def pack(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of the rows of ``docs``.

    A row's ids are its text's and ``end``; null and empty texts have ``end`` alone, so no row is
    without a piece. Every row counts as a document of its own, also where a doc_id repeats or is
    null. Other columns are ignored. start counts the row's ids before the piece; ids_crc32 is over
    its ids as little-endian unsigned 32-bit integers. An empty table gives no sequence.
    """
    end = np.array([config.end], "<u4").tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode, packer = encoder(config), Packer(config.window, config.spaces, task << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                packer.add((doc_id, 0, ids, len(ids) // 4))
            yield packer.batch()
        for doc_id, start, ids, tokens in packer.merge():
            packer.rows.append((doc_id, start, len(ids) // 4, None, tokens, None, None, ids, task))
        yield packer.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None
        for batch in batches:
            for doc_id, start, ids, tokens, of in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "group_id")), strict=True):
                if of != group:
                    if packer:
                        packer.finish(packer.merge())
                        yield packer.batch()
                    packer, group = Packer(config.window, config.spaces, (1 << 62) + (of << 32)), of
                packer.add((doc_id, start, ids, tokens))
        if packer:
            packer.finish(packer.merge())
            yield packer.batch()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = materialise(small_batches(docs).mapInArrow(fill, _ROWS), "placed")
    left = placed.filter("sequence_id IS NULL").withColumn("group_id", F.floor(F.col("task") / config.leftovers).cast("long"))
    merged = left.repartition("group_id").sortWithinPartitions("group_id", "task", "doc_id", "start").mapInArrow(merge, _ROWS)
    return placed.filter("sequence_id IS NOT NULL").unionByName(merged).drop("ids", "task")
