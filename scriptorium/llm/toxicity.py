"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words, and of word prefixes for inflected stems, is trained
in numpy on labelled documents. For each
sentence that names a group, a twin is made in which the identity term is swapped for another;
the loss has a penalty on the squared difference of the two scores, so the model can't lean on
the mention of a group. Words are chosen on the executors, and only a bounded sample of labelled
documents, as word numbers, reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import held_out, materialise, small_batches

#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino", "african"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("young", "old", "elderly"),
)


@dataclass(frozen=True)
class ToxicityConfig:
    """sample: most labelled documents that training sees (taken in the order of a hash of their ids).

    words: most words, and most prefixes, in the model; prefixes: letters of the prefixes of longer words.
    least_z: z-score of a word's or prefix's log odds ratio between the classes, at least.
    ridge and fairness weigh the squared weights and the squared counterfactual score changes.
    """

    sample: int = 16_000
    words: int = 20_000
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    least_z: float = 2.5
    ridge: float = 1e-6
    fairness: float = 1.0
    steps: int = 500
    rate: float = 0.1
    threshold: float = 0.3
    modulus: int = 4
    remainder: int = 2
    terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_TERMS = frozenset(t for kind in IDENTITY_TERMS for t in kind)
#: Rows whose features are in memory at once.
_ROWS = 256


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(words: Iterable[str], prefixes: tuple[int, ...], terms: frozenset[str] = _TERMS) -> set[str]:
    """``words`` and, marked by ``*``, their prefixes: a stem counts as one feature however its word ends.

    Identity terms count as themselves alone, so that the penalty has one weight of each to hold down.
    """
    words = set(words)
    return words | {w[:n] + "*" for w in words if w not in terms for n in prefixes if len(w) > n}


def counterfactuals(text: str | None, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """(words, words of the twin) of each sentence that holds an identity term, with the term swapped for the next of its kind."""
    following = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    found = []
    for sentence in _SENTENCE.split((text or "").lower()):
        own = _WORD.findall(sentence)
        if any(w in following for w in own):
            found.append((set(own), {following.get(w, w) for w in own}))
    return found


class Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, rows: list[list[int]], columns: int) -> None:
        self.columns, self.n = columns, len(rows)
        self.lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.index = np.fromiter((i for r in rows for i in r), np.int64, int(self.lengths.sum()))
        self.of = np.repeat(np.arange(len(rows)), self.lengths)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.index], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, r[self.of], self.columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[list[int]], labels: list[int], twins: list[tuple[list[int], list[int]]], columns: int, config: ToxicityConfig) -> np.ndarray:
    """Weights of the words, and the bias last, by Adam on the regularised loss; without a row every text is scored 0."""
    x, y = Rows(rows, columns), np.asarray(labels, float)
    a, b = Rows([t[0] for t in twins], columns), Rows([t[1] for t in twins], columns)
    w, m, v = np.zeros(columns + 1), np.zeros(columns + 1), np.zeros(columns + 1)
    if not len(y):
        w[-1] = -40
        return w
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(rate / (1 - rate))
    for step in range(1, config.steps + 1):
        wrong = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / len(y)
        grad = np.append(x.back(wrong) + config.ridge * w[:-1], wrong.sum())
        if twins:
            p, q = sigmoid(a.dot(w[:-1]) + w[-1]), sigmoid(b.dot(w[:-1]) + w[-1])
            change = 2 * config.fairness * (p - q) / len(twins)
            ga, gb = change * p * (1 - p), -change * q * (1 - q)
            grad += np.append(a.back(ga) + b.back(gb), ga.sum() + gb.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass(frozen=True)
class ToxicityModel:
    number: dict[str, int]
    weights: np.ndarray
    prefixes: tuple[int, ...] = ToxicityConfig.prefixes
    terms: frozenset[str] = _TERMS

    def known(self, text: str | None) -> list[int]:
        """The numbers of the text's features that the model has, in their order, so that equal texts sum alike on every machine."""
        return sorted(self.number[x] for x in features(words_in(text), self.prefixes, self.terms) if x in self.number)

    def score(self, text: str | None) -> float:
        """0 to 1; a text without known words or prefixes, null and empty ones too, has the score of the bias."""
        return float(sigmoid(np.array(self.weights[self.known(text)].sum() + self.weights[-1])))

    def rejects(self, text: str | None, threshold: float) -> bool:
        """Whether the score reaches ``threshold`` by something in the text: one that says nothing the model knows is never rejected for the share of toxic rows alone."""
        known = self.known(text)
        return bool(known) and float(sigmoid(np.array(self.weights[known].sum() + self.weights[-1]))) >= threshold


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learns from rows of ``labels`` (doc_id, toxic) whose document isn't held out. Exact copies count once.

    A document with contradicting labels, a null label or a null text is left out; without any
    label left, every score is 0 (to 10^-17).
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out("doc_id", config.modulus, config.remainder) & F.col("toxic").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic")
    terms = frozenset(t for kind in config.terms for t in kind)
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [counterfactuals(t, config.terms) for t in texts]
            arrays = [batch.column("toxic"), pa.array([sorted(words_in(t)) for t in texts], pa.list_(pa.string())), pa.array([[sorted(a) for a, _ in p] for p in pairs], pa.list_(pa.list_(pa.string()))), pa.array([[sorted(b) for _, b in p] for p in pairs], pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "words", "own", "twin"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    # At most config.sample rows of two numbers.
    seen = small_batches(texts).join(F.broadcast(chosen), "doc_id").mapInArrow(read, "toxic int, words array<string>, own array<array<string>>, twin array<array<string>>")
    seen = materialise(seen, "toxicity_sample").groupBy("words", "toxic").agg(F.min(F.struct("own", "twin")).alias("pairs"))
    seen = materialise(seen, "toxicity_texts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = [list(features(x, config.prefixes, terms)) for x in part.column("words").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "features"])

    counts = small_batches(seen.select("toxic", "words")).mapInArrow(spread, "toxic int, features array<string>")
    counts = counts.select("toxic", F.explode("features").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = seen.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = (totals["bad"] or 0) + 1, (totals["good"] or 0) + 1
    ratio = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    # The ratio's z-score, by the variance of its counts: words that only chance divides stay out.
    pull = F.abs(ratio) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    known = materialise(counts.filter(pull >= config.least_z).select("word", pull.alias("pull")), "toxicity_words")
    # A limit for each, so that prefixes take no word's place.
    kinds = (known.filter(~F.col("word").endswith("*")), known.filter(F.col("word").endswith("*")))
    chosen_words = [row["word"] for kind in kinds for row in kind.orderBy(F.desc("pull"), "word").limit(config.words).collect()]
    number = {word: i for i, word in enumerate(chosen_words)}
    shared = seen.sparkSession.sparkContext.broadcast(number)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        numbers = lambda words: sorted(known[w] for w in features(words, config.prefixes, terms) if w in known)
        lists = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            found = [numbers(words) for words in batch.column("words").to_pylist()]
            pairs = [[(numbers(a), numbers(b)) for a, b in zip(p["own"], p["twin"], strict=True)] for p in batch.column("pairs").to_pylist()]
            sides = [pa.array([[x[side] for x in p] for p in pairs], lists) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32())), *sides], names=["toxic", "found", "own", "twin"])

    # At most config.sample rows, of numbers only; sorted here, by everything, so that sums don't depend on the order of tasks.
    known_rows = seen.mapInArrow(numbered, "toxic int, found array<int>, own array<array<int>>, twin array<array<int>>").collect()
    known_rows = sorted(map(tuple, known_rows))
    twins = [pair for _, _, own, twin in known_rows for pair in zip(own, twin, strict=True)]
    weights = train([found for _, found, _, _ in known_rows], [toxic for toxic, _, _, _ in known_rows], twins, len(number), config)
    return ToxicityModel(number, weights, config.prefixes, terms)


def score(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; other columns are ignored). Whole texts count."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([known.score(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = small_batches(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", config.modulus, config.remainder).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs`` with all its columns, without rows whose score reaches the threshold by features that the model knows.

    Null and empty texts, texts without a known feature and, without labels, all rows stay; repeated rows go or stay together; ids play no part.
    An empty table gives an empty table.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not known.rejects(t, config.threshold) for t in batch.column("text").to_pylist()], pa.bool_())).select(names)

    return small_batches(docs).mapInArrow(run, docs.schema)
