import hashlib
import re
from collections import defaultdict

import pytest

from scriptorium.llm import pii, queries

from .helpers import frame, table

# The contract's patterns as they stand.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(PATTERNS)


def checksum(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_base(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            own = m.group()
            digits = re.sub("[^0-9]", "", own)
            if {"email": lambda: True, "ip": lambda: all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in own.split(".")), "card": lambda: 12 <= len(digits) <= 19 and checksum(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                found.append((m.start(), k, m.end()))
    return sorted(found)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


ODD = [
    "",
    "a@b.c@d.e a@b@c.d ..@x.y. é@x.y éa@x.y a@-.- @x.y a@x",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1000 0001.02.3.0000255 1..2.3.4 12.3.4 1.2.3.4a",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111114111111111111111 0 00 000000000000",
    "+1 (310) 555-4510 +12 3 +1234567890123456 ++49 30 1234567 +4. 4",
    "1" * 3000 + "." + "2" * 3000,
    "a" * 3000 + "@" + "b" * 3000,
    "x@" * 3000 + "1-" * 3000 + "+1" * 3000,
    "\n+1 310\t555 4510\nmail: Ann.Lee@Mail.example.com, 10.0.0.1;",
]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_base_spans_of_all_texts(spark, sf):
    for row in table(spark, sf, "documents").collect():
        assert pii.base_spans(row.text or "") == brute_base(row.text or "")


def unit_list(text):
    return ["\x02", "\x02", *("0" if u.isdecimal() else u.lower() for u in re.findall(r"\w+|[^\w\s]", text)), "\x03", "\x03"]


def brute_known(texts, support=3, precision=0.6, rounds=4):
    """Instances known at the end, by dictionaries."""
    slots, totals = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    seeds = set()
    for text in texts:
        units = unit_list(text)
        for pair in zip(units, units[1:]):
            totals[pair] += 1
        base = brute_base(text)
        for a, k, b in base + pii.candidate_spans(text, base):
            key = (k, pii.instance(k, text[a:b]))
            if (a, k, b) in base:
                seeds.add(key)
            slots[k, "before", tuple(unit_list(text[:a])[:-2][-2:])][key] += 1
            slots[k, "behind", tuple(unit_list(text[b:])[2:][:2])][key] += 1
    known = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        trust = {}
        for slot, held in slots.items():
            own = [x for x in held if x in known]
            share = min(0.999, sum(held[x] * known[x] for x in own) / max(totals[slot[2]], sum(held.values())))
            if len(own) >= support and share >= precision:
                trust[slot] = share
        doubt = defaultdict(lambda: 1.0)
        for slot, share in trust.items():
            for x in slots[slot]:
                doubt[x] *= 1 - share
        known = dict.fromkeys(seeds, 1.0) | {x: 1 - d for x, d in doubt.items() if x not in seeds and 1 - d >= precision}
    return set(known)


def phrases():
    """Texts in which ``call me at`` and ``behind the line`` hold phones, and one number is only ever seen there without its plus."""
    rows = [(i, f"please call me at +1 310 555 45{i}0 behind the line") for i in range(10, 15)]
    rows += [(20, "please call me at 310-555-9999 behind the line"), (21, "the number 310-555-9999 again"), (22, "the parcel 310-555-8888 again"), (23, None), (24, ""), (None, "call me at 310-555-9999"), (20, "please call me at 310-555-9999 behind the line")]
    rows += [(30, "write to ann (at) example (dot) org or to ann@example.org"), (31, "cards 4111111111111111 4111111111111111 and 4111111111111111")]
    return rows


def test_patterns_find_unseen_identifiers(spark):
    rows = phrases()
    got = sorted(((r.doc_id, r.spans) for r in pii.report(frame(spark, rows)).collect()), key=str)
    known = brute_known([t or "" for _, t in rows])
    want = []
    for doc_id, text in rows:
        text = text or ""
        base = brute_base(text)
        added = [s for s in pii.candidate_spans(text, base) if (s[1], pii.instance(s[1], text[s[0] : s[2]])) in known]
        want.append((doc_id, listed(sorted(base + added))))
    assert got == sorted(want, key=str)
    spans = {d: s for d, s in got if d is not None}
    assert spans[20] == "phone:18:30" and spans[21] == "phone:11:23" and spans[22] == ""
    assert spans[30] == "email:9:35,email:42:57" and spans[31] == "card:6:22,card:23:39,card:44:60"


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect()]
    known = brute_known([t for _, t in rows])
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, sf).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base, row = brute_base(text), got[doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert row.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        added, end = [], -1
        for s in sorted(pii.candidate_spans(text, base)):
            if s[0] >= end and (s[1], pii.instance(s[1], text[s[0] : s[2]])) in known:
                added.append(s)
                end = s[2]
        assert row.spans == listed(sorted(base + added))


def test_empty_table(spark):
    assert pii.report(frame(spark, [(1, "x")]).limit(0)).collect() == []


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_counts_of_pairs_are_of_listed_pairs(spark, sf, most):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    want = defaultdict(int)
    for row in docs.collect():
        for pair in pii.pairs_of(row.text or "").view("int64").tolist():
            want[pair] += 1
    some = sorted(want)[::50]
    pairs = spark.createDataFrame([(p,) for p in [*some, 17]], "pair long")
    got = dict(pii.pair_counts(docs, pairs, pii.PiiConfig(max_listed=most)).collect())
    assert {p: got.get(p) for p in some} == {p: want[p] for p in some}
    # The list lets nothing else through, so that rows grow with the pairs and not with the texts.
    assert most == 0 or set(got) == set(some)
