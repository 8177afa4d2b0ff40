import hashlib
import random
import re
from statistics import mean

import pytest
import xxhash

from quillspark.llm import syncmers
from quillspark.llm.syncmers import SLOTS, K, S, anchors, fingerprint_edits

SCHEMA = "doc_id long, text string, k long, h string, w string"
MASK = 2**64 - 1


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def brute_anchors(text):
    b = text.encode()
    if len(b) < K:
        return [(0, xxhash.xxh64_intdigest(b, 42) | 2**63)] if b else []
    out = []
    for p in range(len(b) - K + 1):
        s = [signed(xxhash.xxh64_intdigest(b[p + j : p + j + S], 42)) for j in range(K - S + 1)]
        if min(s) in (s[0], s[-1]):
            h = xxhash.xxh64_intdigest((s[0] & MASK).to_bytes(8, "little"), 42)
            h = xxhash.xxh64_intdigest((s[-1] & MASK).to_bytes(8, "little"), h)
            out.append((p, h & 2**63 - 1 if s[0] in s[1:] else h | 2**63))
    return out


def brute_print(text):
    slots = [None] * SLOTS
    for p, h in brute_anchors(text):
        v, old = h >> 33, slots[h % SLOTS]
        slots[h % SLOTS] = (v, p, p) if old is None or v < old[0] else (v, old[1], p) if v == old[0] else old
    return slots


def as_text(slots):
    return ",".join("" if s is None else f"{s[0]:x}:{s[1]:x}" + (f":{s[2]:x}" if s[2] != s[1] else "") for s in slots)


def covered(a, b, n_a, n_b):
    if not any(x and y and x[0] == y[0] for x, y in zip(a, b)):
        return 0
    points = [(0, 0), (n_a, n_a - n_b)]
    for x, y in zip(a, b):
        if x and y and x[0] == y[0]:
            d = x[1] - y[1]
            points += [(x[1], d), (max(x[1], min(x[2], y[2] + d)), d)]
        elif x and (y is None or y[0] > x[0]):
            points += [(x[1], None), (x[2], None)]
    points.sort(key=lambda q: (q[0], q[1] is not None, q[1] or 0))
    total = 0
    for (p, d), (q, e) in zip([(0, None), *points], points):
        total += q - p if d is not None and d == e else min(K, q - p) if d is not None and p < n_a else 0
    return total


def likeness(x, y):
    a, b, n, m = brute_print(x), brute_print(y), len(x.encode()), len(y.encode())
    return (covered(a, b, n, m) + covered(b, a, m, n)) / (n + m) if n + m else 1.0


def brute(rows):
    ids = sorted({d for d, *_ in rows}, key=lambda d: (d is None, d or 0))
    first = {d: min((t or "" for e, t, *_ in rows if e == d), key=lambda t: t.encode()) for d in ids}
    out = []
    for d, t, *_ in rows:
        t, after = t or "", first[ids[(ids.index(d) + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, e = as_text(brute_print(t)), as_text(brute_print(edited))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, round(likeness(t, edited), 9), round(likeness(t, after), 9)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    out = [(i * 3 - 40, rng.choice([" ", "\n", "  "]).join(rng.choice(["é", "😀b", "the", "of", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 10, 30, 200]))), 1, "x", None) for i in range(60)]
    spaceless = [(600, "x" * 4000), (601, "ab" * 900), (602, "漢字仮名" * 40), (603, "eleven char"), (604, "y")]
    return [*out, (500, None, None, None, None), (501, "", None, None, None), *((i, t, None, None, None) for i, t in spaceless)]


@pytest.mark.parametrize("more", [[], [(500, "zz " * 50, 1, None, None), (-40, "a b c", None, None, None), (-40, "a b c", None, None, None), (None, "no number at all here", None, None, None)]])
def test_against_brute_force(spark, monkeypatch, more):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    monkeypatch.setattr(syncmers, "BLOCK", 50)
    r = rows() + more
    got = fingerprint_edits(spark.createDataFrame(r, SCHEMA)).collect()
    assert sorted(((*x[:5], round(x.near_edited, 9), round(x.near_next, 9)) for x in got), key=str) == brute(r)


def test_anchors_are_context_free(spark):
    rng = random.Random(4)
    body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    found = {}
    for r in anchors(spark.createDataFrame([(1, body, 0, "", ""), (2, f"new words before {body} and after", 0, "", "")], SCHEMA)).collect():
        found.setdefault(r.doc_id, set()).add((r.p, r.h & MASK))
    assert found[1] == set(brute_anchors(body))
    assert {(p + 17, h) for p, h in found[1]} <= found[2]


def test_edits_keep_likeness(spark):
    """Three quarters of a text stay: also of short texts, of texts without spaces and of texts that repeat themselves."""
    rng = random.Random(6)
    r = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200)), 0, "", "") for i in range(40)]
    r += [(100 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(7)), 0, "", "") for i in range(40)]
    r += [(200, "x" * 4000, 0, "", ""), (201, "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(900)), 0, "", ""), (202, "end", 0, "", "")]
    got = {x.doc_id: x for x in fingerprint_edits(spark.createDataFrame(r, SCHEMA)).collect()}
    assert abs(mean(got[i].near_edited for i in range(40)) - 0.75) < 0.04 and max(got[i].near_next for i in range(40)) < 0.1
    assert abs(mean(got[i].near_edited for i in range(100, 140)) - 0.75) < 0.15
    assert abs(got[200].near_edited - 0.75) < 0.15 and abs(got[201].near_edited - 0.75) < 0.1


def test_places_count():
    """Equal hashes at places that do not agree are no likeness."""
    a = [(5, 10 * i, 10 * i) for i in range(SLOTS)]
    b = [(5, 7 * (SLOTS - i) ** 2, 7 * (SLOTS - i) ** 2) for i in range(SLOTS)]
    assert covered(a, a, 320, 320) == 320 and covered(a, b, 10_000, 10_000) <= K * (SLOTS + 1)


def test_empty(spark):
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []
