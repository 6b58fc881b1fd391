import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from scriptorium.llm.packing import PackConfig, WordEncoder, pack, public_vocabulary
from scriptorium.llm.queries import op9_packing
from tests.llm.helpers import frame, table


def whole(texts):
    t = Tokenizer.from_file(public_vocabulary())
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def verify(rows, pieces, window=4096, most_padding=0.05):
    """Each id of each row in exactly one piece; sequences gapless, full or of a power of two."""
    ids = whole([t or "" for _, t in rows])
    want, left = defaultdict(list), defaultdict(list)
    for (doc_id, _), x in zip(rows, ids, strict=True):
        want[doc_id].append(x)
    for p in pieces:
        left[p.doc_id].append(p)
    assert set(want) == set(left)
    for doc_id, own in left.items():
        assert sum(p.length for p in own) == sum(map(len, want[doc_id]))
        for p in own:
            assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and p.start + p.length <= len(x) for x in want[doc_id])
        if len(want[doc_id]) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= most_padding * total


def test_query_against_the_tokenizer(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    verify(rows, op9_packing(spark, sf).collect())


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "word " * 30_000), (4, "x"), (5, "É é\u0085 İ ﬁ é \x1c a\x1fb"), (6, "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>"), (7, "it's  don't\n1234 ½ ² ^^^ \x00\x7f")]
    verify(rows, pack(frame(spark, rows).repartition(3)).collect())
    assert pack(frame(spark, [])).collect() == []


def test_small_windows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("cat", "dog", "house", "tree")) for _ in range(rng.randrange(90)))) for i in range(300)]
    verify(rows, pack(frame(spark, rows).repartition(5), PackConfig(window=64, spaces=3, leftovers=2)).collect(), 64)


def test_words_encode_as_the_whole_text():
    rng = random.Random(2)
    encode, tokenizer = WordEncoder(public_vocabulary(), 1000), Tokenizer.from_file(public_vocabulary())
    alphabet = "abcXYZ019 '’.,!?<|>-_\n\t éÀßñ漢字😀́İ ªµ²½\x1d\x00"
    for _ in range(600):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
