"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's
largest response over the window goes through a softmax layer. A text is cut into windows that
cover all of it; its prediction is the softmax of the mean of their logits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import held_out, materialise

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    """window: bytes of a window. sample: most labelled documents, in equal shares of each language; windows: most windows of their texts, too."""

    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    depth: int = 8
    sample: int = 4000
    windows: int = 12_000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.004
    modulus: int = 3
    remainder: int = 1
    seed: int = 4


_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: str, window: int) -> np.ndarray:
    """The text's bytes in rows of ``window``, A-Z lower-cased, padded by zeros behind the end; every byte is in one row."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(1, -(-len(data) // window))
    out = np.zeros(rows * window, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, window)


class ByteNet:
    """embedding (256, depth) -> for each width: filters over ``width`` bytes, maximum over the window, ReLU -> softmax."""

    def __init__(self, config: LangConfig, languages: list[str]) -> None:
        self.config, self.languages = config, languages
        rng = np.random.default_rng(config.seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"e": draw(256, config.depth, s=0.5), "out": draw(len(config.widths) * config.filters, len(languages), s=0.1), "bias": np.zeros(len(languages), np.float32)}
        for w in config.widths:
            self.p[f"f{w}"] = draw(w * config.depth, config.filters, s=1 / np.sqrt(w * config.depth))
            self.p[f"b{w}"] = np.zeros(config.filters, np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e, kept, pooled = self.p["e"][x], [], []
        n, length, depth = e.shape
        for w in self.config.widths:
            seen = np.lib.stride_tricks.sliding_window_view(e.reshape(n, length * depth), w * depth, axis=1)[:, ::depth]
            responses = np.ascontiguousarray(seen).reshape(-1, w * depth) @ self.p[f"f{w}"]
            responses = responses.reshape(n, length - w + 1, -1)
            at = responses.argmax(axis=1)
            best = np.take_along_axis(responses, at[:, None], axis=1)[:, 0] + self.p[f"b{w}"]
            kept.append((at, best > 0))
            pooled.append(np.maximum(best, 0))
        h = np.concatenate(pooled, axis=1)
        return h @ self.p["out"] + self.p["bias"], [h, kept]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """As forward, by one product for all widths: shorter filters are padded by zeros, and responses past a window's end left out."""
        c, widest, shortest = self.config, max(self.config.widths), min(self.config.widths)
        if not hasattr(self, "filters"):
            rows = widest * c.depth
            self.filters = np.concatenate([np.pad(self.p[f"f{w}"], ((0, rows - w * c.depth), (0, 0))) for w in c.widths], axis=1)
            self.biases = np.concatenate([self.p[f"b{w}"] for w in c.widths])
        out = np.empty((len(x), len(self.languages)), np.float32)
        # Few windows at a time: what they need stays in the processor's cache.
        for i in range(0, len(x), 24):
            part = x[i : i + 24]
            n, length = part.shape
            at = length - shortest + 1
            e = np.zeros((n, at + widest - 1, c.depth), np.float32)
            e[:, :length] = self.p["e"][part]
            seen = np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), widest * c.depth, axis=1)[:, :: c.depth]
            responses = (np.ascontiguousarray(seen).reshape(n * at, -1) @ self.filters).reshape(n, at, -1)
            for k, w in enumerate(c.widths):
                responses[:, length - w + 1 :, k * c.filters : (k + 1) * c.filters] = -np.inf
            out[i : i + n] = np.maximum(responses.max(axis=1) + self.biases, 0) @ self.p["out"] + self.p["bias"]
        return out

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross entropy, in shuffled batches."""
        c, rng = self.config, np.random.default_rng(self.config.seed + 1)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for epoch in range(c.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), c.batch):
                rows = order[i : i + c.batch]
                grads, step = self.gradients(x[rows], y[rows]), step + 1
                rate = c.rate * (1 - epoch / c.epochs)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (h, kept) = self.forward(x)
        d = softmax(z)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        grads = {"out": h.T @ d, "bias": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = d @ self.p["out"].T
        f = self.config.filters
        for j, (w, (at, live)) in enumerate(zip(self.config.widths, kept, strict=True)):
            g = dh[:, j * f : (j + 1) * f] * live
            grads[f"b{w}"] = g.sum(axis=0)
            # The bytes under each filter's best position: (rows, filters, width).
            under = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(w)]
            grads[f"f{w}"] = np.einsum("nf,nfwd->wdf", g, self.p["e"][under]).reshape(w * self.config.depth, f)
            back = np.einsum("nf,wdf->nfwd", g, self.p[f"f{w}"].reshape(w, self.config.depth, f))
            np.add.at(grads["e"], under.ravel(), back.reshape(-1, self.config.depth))
        return grads


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame, config: LangConfig = LangConfig()) -> ByteNet | None:
    """Learns from (text, lang) of documents that aren't held out; None if no such row has a language and a letter.

    Each language has an equal share of config.sample rows, the first in the order of a hash of their ids, and of
    config.windows windows, the first in the order of a hash of all windows of these rows' whole texts. Classes are
    balanced by repeating windows of the rarer languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out("doc_id", config.modulus, config.remainder) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = rows.select("lang").distinct().count()
    share = lambda most: max(1, most // max(1, languages))
    # Ids first, so that ranking doesn't move texts; the filter on row_number runs as a group limit before the shuffle.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share(config.sample)).select("doc_id", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if _LETTER.search(text):
                    found = windows_of(text, config.window)
                    langs += [lang] * len(found)
                    parts += map(bytes, found)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    cuts = materialise(rows.join(F.broadcast(chosen), ["doc_id", "lang"]).mapInArrow(cut, "lang string, part binary"), "lang_windows").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("part"), "part")
    cuts = cuts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share(config.windows)).select("lang", "part")
    found = cuts.orderBy("lang", "part").collect()
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    x = np.frombuffer(b"".join(r["part"] for r in found), np.uint8).reshape(len(found), config.window)
    y = np.array([languages.index(r["lang"]) for r in found])
    counts = np.bincount(y)
    repeated = np.repeat(np.arange(len(y)), np.minimum(4, -(-counts.max() // counts))[y])
    net = ByteNet(config, languages)
    net.learn(x[repeated], y[repeated])
    return net


def predict(docs: DataFrame, net: ByteNet | None, config: LangConfig = LangConfig()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``und`` with score 0 for null texts, texts without a letter, and if nothing was learned. Every
    byte of a text is in a window; its windows' logits count alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            held, rows = [], 0

            def done() -> None:
                nonlocal held, rows
                if held:
                    z = net.logits(np.concatenate([w for _, w in held]))
                    at = 0
                    for i, w in held:
                        p = softmax(z[at : at + len(w)].astype(np.float64).mean(axis=0))
                        langs[i], scores[i] = net.languages[int(p.argmax())], float(p.max())
                        at += len(w)
                held, rows = [], 0

            for i, text in enumerate(texts):
                if net is not None and text and _LETTER.search(text):
                    held.append((i, windows_of(text, config.window)))
                    rows += len(held[-1][1])
                    if rows >= 2048:
                        done()
            done()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id", config.modulus, config.remainder).alias("held_out"), "lang_pred", "score")
