import numpy as np

from scriptorium.llm.langid import ByteNet, LangConfig, fit, predict, softmax, windows_of
from scriptorium.llm.queries import op4_language
from tests.llm.helpers import crc, frame, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = op4_language(spark, sf).collect()
    assert len(rows) == len(langs) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_gradients_are_right():
    config = LangConfig(window=12, widths=(2, 3), filters=3, depth=2)
    net, rng = ByteNet(config, ["a", "b"]), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 105, (4, 12)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(softmax(net.forward(x)[0])[np.arange(4), y]).mean()
    grads = net.gradients(x, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(grads[k].reshape(-1)), 4):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - grads[k].reshape(-1)[i]) < 1e-4


def test_fast_logits_equal_forward():
    net = ByteNet(LangConfig(), ["a", "b", "c"])
    x = windows_of("some text that is longer than a window, é, " * 9, 128)
    assert np.allclose(net.logits(x), net.forward(x)[0], atol=1e-4)
    assert windows_of("x" * 129, 128).shape == (2, 128) and windows_of("", 128).shape == (1, 128)


def test_odd_rows(spark):
    learn = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    docs = frame(spark, learn)
    net = fit(docs, LangConfig(epochs=20))
    odd = frame(spark, [(1, None), (2, ""), (3, "123 ..."), (4, "the dog and the cat"), (4, "the dog and the cat"), (None, "die Katze und der Hund"), (5, "und der Hund " * 20_000)])
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in predict(odd, net).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", crc(1, 3) == 1), (2, "und", crc(2, 3) == 1), (3, "und", crc(3, 3) == 1), (4, "en", crc(4, 3) == 1), (4, "en", crc(4, 3) == 1), (None, "de", True), (5, "de", crc(5, 3) == 1)], key=str)
    assert fit(frame(spark, [(1, "x", None), (2, None, "en"), (3, "1", "en")])) is None
    assert {r.lang_pred for r in predict(odd, None).collect()} == {"und"}
    assert predict(frame(spark, []), net).collect() == []


def test_held_out_rows_are_never_seen(spark):
    rows = [(i, ("the cat " if i % 2 else "der Hund ") * 3, "en" if i % 2 else "de") for i in range(40)]
    turned = [(d, "junk words" if crc(d, 3) == 1 else t, "xx" if crc(d, 3) == 1 else x) for d, t, x in rows]
    one, two = (fit(frame(spark, x), LangConfig(epochs=2)) for x in (rows, turned))
    assert one.languages == two.languages and all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
