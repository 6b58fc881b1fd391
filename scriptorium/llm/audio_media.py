"""Media columns: audio stored as 8-bit WAV, and features of it as fixed-shape tensors with time spans.

Features: polyphase resampling by 2/3, overlapped frames under a Hann window, log-mel filterbank,
frame energies with hysteresis segmentation. A clip's log-mel frames are pooled to a fixed number
of time steps, so the tensor has one shape for every clip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AudioConfig:
    """rate: samples a second as stored. up/down: resampling. on/off: thresholds in decibels around a clip's mean energy."""

    rate: int = 12000
    up: int = 2
    down: int = 3
    taps: int = 12
    frame: int = 256
    hop: int = 128
    mels: int = 20
    steps: int = 8
    on: float = 1.0
    off: float = -1.0
    chunk: int = 1 << 18


# -- the stored form ---------------------------------------------------------------------------


def wav(samples: bytes, rate: int) -> bytes:
    """A RIFF WAVE file: one channel of unsigned 8-bit samples."""
    pad = len(samples) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def unwav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, by walking the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        if kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


# -- features ----------------------------------------------------------------------------------


@lru_cache(8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass filter, split into the phases of ``up`` outputs a period: (taps, up)."""
    cut = 1 / max(up, down)
    n = np.arange(taps * up) - (taps * up - 1) / 2
    h = cut * up * np.sinc(cut * n) * np.hanning(taps * up + 2)[1:-1]
    phases = np.zeros((taps + down, up), np.float32)
    for p in range(up):
        shift, phase = divmod(p * down, up)
        own = h[phase::up][::-1][:taps]
        phases[shift : shift + len(own), p] = own / own.sum()
    return phases


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """``x`` at up/down of its rate: each period of ``down`` inputs gives ``up`` outputs, one for each filter phase."""
    phases = _phases(up, down, taps)
    periods = -(-len(x) // down)
    padded = np.zeros(periods * down + len(phases), np.float32)
    padded[taps // 2 : taps // 2 + len(x)] = x
    seen = np.lib.stride_tricks.sliding_window_view(padded, len(phases))[::down][:periods]
    return (seen @ phases).ravel()[: -(-len(x) * up // down)]


@lru_cache(8)
def _mel(frame: int, mels: int, rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a frame's spectrum: (bins, mels)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1) / rate * frame
    bins = np.arange(frame // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (bins - low) / np.maximum(mid - low, 1e-9), (high - bins) / np.maximum(high - mid, 1e-9)
    bank = np.clip(np.minimum(up, down), 0, None)
    bank[np.clip(np.round(mid).astype(int), 0, frame // 2), np.arange(mels)] += 1e-3  # no filter is empty
    return bank.astype(np.float32)


def log_mel(x: np.ndarray, config: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and the frames' own energies in decibels; a short clip is padded to one frame."""
    if len(x) < config.frame:
        x = np.pad(x, (0, config.frame - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, config.frame)[:: config.hop]
    bank, window = _mel(config.frame, config.mels, config.rate * config.up / config.down), np.hanning(config.frame).astype(np.float32)
    spectra, powers = [], []
    for i in range(0, len(frames), 1024):
        part = frames[i : i + 1024] * window
        s = np.fft.rfft(part, axis=1)
        power = (s.real**2 + s.imag**2).astype(np.float32)
        spectra.append(np.log(power @ bank + 1e-6))
        powers.append(10 * np.log10((part.astype(np.float64) ** 2).mean(axis=1) + 1e-9))
    return np.concatenate(spectra), np.concatenate(powers)


def hysteresis(level: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs of frames that stay above ``off`` and reach ``on`` somewhere: [start, stop)."""
    above = np.diff(np.concatenate(([0], (level > off).astype(np.int8), [0])))
    starts, stops = np.flatnonzero(above == 1), np.flatnonzero(above == -1)
    reached = np.concatenate(([0], np.cumsum(level > on)))
    keep = reached[stops] > reached[starts]
    return list(zip(starts[keep].tolist(), stops[keep].tolist(), strict=True))


def features(samples: bytes, config: AudioConfig) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The (steps, mels) tensor of a clip and the time spans, in seconds, of its active parts.

    Long clips are resampled and framed in chunks that are whole numbers of hops, so that memory
    doesn't grow with their length beyond one number a frame and band.
    """
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    tables, levels = [], []
    period = config.down * config.hop
    step = config.chunk - config.chunk % period
    over = -(-config.frame * config.down // config.up) + 2 * config.taps
    for i in range(0, max(1, len(x)), step):
        # A period of what is before and some of what is behind, so that filters see across the cuts.
        before = period if i else 0
        y = resample(x[i - before : i + step + over], config.up, config.down, config.taps)
        frames, level = log_mel(y, config)
        first = before * config.up // config.down // config.hop
        n = first + step * config.up // config.down // config.hop if i + step < len(x) else len(frames)
        tables.append(frames[first:n])
        levels.append(level[first:n])
    table, level = np.concatenate(tables), np.concatenate(levels)
    cuts = np.linspace(0, len(table), config.steps + 1).astype(int)
    tensor = np.stack([table[min(a, len(table) - 1) : max(b, a + 1)].mean(axis=0) if a < len(table) else table[-1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    seconds = config.hop / (config.rate * config.up / config.down)
    mean = float(level.mean())
    return tensor.astype(np.float32), [(a * seconds, b * seconds) for a, b in hysteresis(level - mean, config.on, config.off)]


# -- Spark -------------------------------------------------------------------------------------


def payload_of(text: str | None, multiple: int = 192) -> tuple[bytes, int]:
    """A text's UTF-8 (null: none) with spaces up to a positive multiple, and its length before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // multiple)) * multiple, b" "), len(data)


def store(docs: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as the samples of a WAV file. Null and empty texts are silence of one period.

    Columns other than doc_id and text are ignored; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [payload_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in done], pa.int64()), pa.array([wav(p, config.rate) for p, _ in done], pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensor_type(config: AudioConfig = AudioConfig()) -> pa.DataType:
    """The Arrow type of the tensor column: every clip has this shape."""
    return pa.fixed_shape_tensor(pa.float32(), (config.steps, config.mels), dim_names=("step", "mel"))


def packed_tensor(values: np.ndarray) -> bytes:
    """A tensor as an Arrow tensor message: shape, type and values."""
    sink = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(values)), sink)
    return sink.getvalue().to_pybytes()


def as_tensors(column: pa.Array, config: AudioConfig = AudioConfig()) -> pa.Array:
    """A column of stored tensor messages as an Arrow fixed-shape tensor array, without nulls."""
    values = [pa.ipc.read_tensor(pa.py_buffer(x)).to_numpy() for x in column.to_pylist()]
    flat = pa.array(np.stack(values).ravel() if values else [], pa.float32())
    return pa.ExtensionArray.from_storage(tensor_type(config), pa.FixedSizeListArray.from_arrays(flat, config.steps * config.mels))


MEASURED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensor binary, means array<float>, spans array<struct<start: double, stop: double>>"


def measure(media: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """Reads each stored clip back: digests of its samples and of its file, its feature tensor and its time spans.

    tensor is an Arrow tensor message of shape (steps, mels), the same for every clip (as_tensors makes an
    Arrow fixed-shape tensor array of the column); means are its means over the steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
        for batch in batches:
            rows = []
            for stored in batch.column("media").to_pylist():
                samples, rate = unwav(stored)
                tensor, spans = features(samples, config)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), tensor, [{"start": a, "stop": b} for a, b in spans]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            tensors = pa.array([packed_tensor(r[5]) for r in rows], pa.binary())
            means = pa.array([r[5].mean(axis=0) for r in rows], pa.list_(pa.float32()))
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), tensors, means, pa.array([r[6] for r in rows], span)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensor", "means", "spans"])

    return media.mapInArrow(run, MEASURED)
