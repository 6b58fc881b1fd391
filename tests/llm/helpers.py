"""Fixtures in the shape of the tables, and brute force in plain Python."""

import re
import zlib

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, at int, label int, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def frame(spark, rows):
    """(doc_id, text[, lang[, source]]) rows with extra columns whose names the operators use inside."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *(None,) * (4 - len(r)))
        full.append((doc_id, text, lang, source, len(text or ""), "x", 1, 2, 3, "k"))
    return spark.createDataFrame(full, DOCS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def shingles(text, width=5):
    w = words(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    """{doc_id: component_id} of (doc_id, text) rows, by all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d, _ in rows}
