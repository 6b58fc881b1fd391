import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm.audio_media import AudioConfig, as_tensors, features, hysteresis, log_mel, measure, payload_of, resample, store, tensor_type, unwav, wav
from scriptorium.llm.queries import op8_audio
from tests.llm.helpers import frame, table


def test_file_round_trip():
    for data in (b"", b"\0\xff\x80", bytes(range(256)) * 9):
        assert unwav(wav(data, 12000)) == (data, 12000) and len(wav(data, 1)) % 2 == 0
    import io
    import wave

    with wave.open(io.BytesIO(wav(b"abcd", 12000))) as f:
        assert (f.getframerate(), f.getsampwidth(), f.getnchannels(), f.readframes(9)) == (12000, 1, 1, b"abcd")
    with pytest.raises(ValueError):
        unwav(b"RIFF....nope")


def test_resampling_keeps_low_tones():
    t = np.arange(12000) / 12000
    y = resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 2, 3, 12)
    assert len(y) == 8000
    spectrum = np.abs(np.fft.rfft(y[1000:7000] * np.hanning(6000)))
    assert abs(spectrum.argmax() * 8000 / 6000 - 440) < 3
    high = resample(np.sin(2 * np.pi * 5800 * t).astype(np.float32), 2, 3, 12)
    assert np.abs(high[100:-100]).max() < 0.5 * np.abs(y[100:-100]).max()


def test_mel_and_segments():
    config = AudioConfig()
    t = np.arange(8000) / 8000
    low, high = (log_mel(np.sin(2 * np.pi * f * t).astype(np.float32), config)[0].mean(axis=0).argmax() for f in (300, 2500))
    assert low < high
    assert hysteresis(np.array([0, 2, 0.5, 0.5, -2, 0.5, -2, 3.0]), 1, 0) == [(0, 4), (7, 8)] or hysteresis(np.array([0, 2, 0.5, 0.5, -2, 0.5, -2, 3.0]), 1, 0) == [(1, 4), (7, 8)]
    loud = np.full(12000, 128, np.uint8)
    loud[4000:8000] = (128 + 100 * np.sin(np.arange(4000))).astype(np.uint8)
    _, spans = features(loud.tobytes(), config)
    assert len(spans) == 1 and abs(spans[0][0] - 1 / 3) < 0.05 and abs(spans[0][1] - 2 / 3) < 0.05


def test_chunks_give_the_same_features():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 50_000).astype(np.uint8).tobytes()
    one, two = features(data, AudioConfig()), features(data, AudioConfig(chunk=4096))
    assert np.allclose(one[0], two[0], atol=0.05)


def test_operator_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "x" * 192), (4, "long " * 60_000)]
    media = store(frame(spark, rows))
    got = measure(media).collect()
    assert len(got) == 6
    for r in got:
        text = dict((d, t) for d, t in rows)[r.doc_id]
        payload, n = payload_of(text)
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.means) == 20 and r.media_bytes == len(payload) + 44
        tensor, spans = features(payload, AudioConfig())
        assert np.array_equal(as_tensors(pa.array([bytes(r.tensor)], pa.binary())).to_numpy_ndarray()[0], tensor) and [tuple(s) for s in r.spans] == spans
    column = as_tensors(pa.array([bytes(r.tensor) for r in got], pa.binary()))
    assert column.type == tensor_type() and column.to_numpy_ndarray().shape == (6, 8, 20)
    assert measure(store(frame(spark, []))).collect() == []


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = op8_audio(spark, sf).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        payload, n = payload_of(texts[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == n
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
