import random
import re

import pytest
import xxhash

from quillspark.llm.simhash import links, near_duplicates
from quillspark.operators.graph import components, spread_join

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for _, t, _ in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (f[i] ^ f[j]).bit_count() <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    low = {}
    for (d, _, _), c in zip(rows, comp):
        low[c] = min((x for x in (low.get(c), d) if x is not None), default=None)
    return sorted(((d, f"{x:016x}", low[c]) for (d, _, _), x, c in zip(rows, f, comp)), key=str)


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ÉT", "Zü"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 40, 150, 150)]
    texts = [None, "", " \t\n", "One two", "one\ttwo", *base, *base]
    for b in base[3:]:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append("  ".join(w).upper())
    out = [(i, t, "x") for i, t in enumerate(texts)]
    return [*out, out[7], out[7], (None, "lonely row without a number", None), (3, "another text of doc three", "y")]


@pytest.mark.parametrize("crowd", [4096, 1])
def test_against_brute_force(spark, crowd):
    r = rows()
    got = near_duplicates(spark.createDataFrame(r, SCHEMA), crowd=crowd).collect()
    assert sorted(map(tuple, got), key=str) == brute(r)


@pytest.mark.parametrize("crowd", [40, 0])
def test_links_at_every_crowd(spark, crowd):
    """Full halves beside halves that are not, on either side: the components are those of all pairs."""
    rng = random.Random(8)
    low, high = [rng.getrandbits(32) for _ in range(3)], [rng.getrandbits(32) for _ in range(3)]
    fps = {rng.getrandbits(64) for _ in range(30)}
    for _ in range(60):  # one half of many values beside one, and neighbours of that one in one bit
        fps.add(low[0] | rng.getrandbits(32) << 32)
        fps.add(low[0] ^ 1 << rng.randrange(32) | high[1] << 32)
        fps.add(rng.getrandbits(32) | high[2] << 32)
    for f in rng.sample(sorted(fps), 80):
        for n in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    want = {f: f for f in fps}
    for _ in fps:
        before = dict(want)
        for i, f in enumerate(fps):
            for g in fps[:i]:
                if (f ^ g).bit_count() <= 3:
                    want[f] = want[g] = min(want[f], want[g])
        if before == want:
            break
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    got = links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), crowd).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in got)
    of = {r.node % 2**64: r.component for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
    groups = lambda m: {frozenset(f for f in m if m[f] == x) for x in set(m.values())}
    assert groups({f: of.get(f, ("alone", f)) for f in fps}) == groups(want)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("most", [1, 3, 512])
def test_spread_join_is_a_join(spark, most):
    keys = [k for k in range(40) for _ in range(1 + 60 * (k == 7) + 20 * (k == 9))] + [None, 99]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    ids = rows.where("k < 40").groupBy("k").count().selectExpr("k", "count", "k * 10 as root")
    got = spread_join(rows, ids, "k", "count", most)
    assert got.columns == ["k", "i", "root"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, k * 10) for i, k in enumerate(keys) if k is not None and k < 40)
    assert spread_join(rows.limit(0), ids.limit(0), "k", "count", most).isEmpty()
