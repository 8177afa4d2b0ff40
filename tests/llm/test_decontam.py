import itertools
import random
import re

import pytest

from quillspark.llm.decontam import MASKS, OP4_SQL, contaminated, decontaminated
from tests.oracle import database

DOCS = "doc_id long, text string, item_id string, w string, matched int"
ITEMS = "item_id long, text string, doc_id string"


def toks(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if x]


def brute(docs, items):
    out = {}
    for (d, t, *_), (i, u, *_) in itertools.product(docs, items):
        a, b = toks(t), toks(u)
        if not b:
            continue
        best = max(((sum(0 <= s + j < len(a) and a[s + j] == b[j] for j in range(len(b))), -s) for s in range(-len(b), len(a))), default=(0, 0))
        if best[0] and best[0] >= 0.8 * len(b) - 1e-9:
            out[(d, i)] = max(out.get((d, i), (0,)), (best[0], len(b), -best[1]))
    return {(d, i, n, m) for (d, i), (m, n, _) in out.items()}


def tables():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Éa"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n)), "x") for i, n in enumerate([15, 20, 25, 40, 59, 9, 10, 8, 11, 12, 5, 6, 4])] + [(90, None, None), (91, "", None), (92, "too short to say", None), (93, "Singular", None), (94, "pair of", None)]
    docs = [(0, None, None, None, None), (1, "", "", "", 1), (2, "too short to say " * 9, None, None, None)]
    for i, item, *_ in items[:13]:
        for share in (0, 0.1, 0.2, 0.35, 0.6):
            w = item.split()
            for j in rng.sample(range(len(w)), int(share * len(w))):
                w[j] = "other"
            before, after = ([rng.choice(words) for _ in range(rng.randrange(80))] for _ in range(2))
            docs.append((len(docs), ", ".join([*before, *[x.upper() for x in w], *after]), "t", "u", 3))
    docs.append((len(docs), " ".join(rng.choice(words) for _ in range(20_000)), None, None, None))
    docs.append((len(docs), items[0][1], None, None, None))
    return docs, items


@pytest.mark.parametrize("broadcast_seeds", [400_000, 0])
def test_against_brute_force(spark, broadcast_seeds):
    docs, items = tables()
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_seeds=broadcast_seeds).collect()
    assert {(r.doc_id, r.item_id, r.item_tokens, r.matched) for r in got} == brute(docs, items)
    assert all(r.overlap == r.matched / r.item_tokens for r in got)


def least_that_hide(masks, n):
    """The fewest substitutions in n tokens that touch every placement of every mask, by going through the tokens with
    the last few substitutions as the state."""
    span = max(m[-1] for m in masks) + 1
    costs = {0: 0}
    for i in range(n):
        new = {}
        for state, cost in costs.items():
            for gone in (0, 1):
                s = (state << 1 | gone) & (1 << span) - 1
                if all(i < m[-1] or any(s >> (m[-1] - o) & 1 for o in m) for m in masks):
                    new[s] = min(new.get(s, n + 1), cost + gone)
        costs = new
    return min(costs.values())


def test_masks_lose_nothing_at_any_length():
    # beyond 45 tokens some 15 in a row hold three substitutions at most, or they would be over a fifth of all
    for n in range(1, 61):
        masks = next(m for low, high, m in MASKS if low <= n and (high is None or n <= high))
        assert least_that_hide(masks, n) > n // 5, n


def test_every_way_to_substitute(spark):
    items, docs, want = [], [], set()
    for n in range(1, 14):
        item = [f"t{n}.{j}".replace(".", "x") for j in range(n)]
        items.append((n, " ".join(item), None))
        for way in (c for r in range(n // 5 + 1) for c in itertools.combinations(range(n), r)):
            want.add((len(docs), n, n - len(way), 1))
            docs.append((len(docs), " ".join(["before", *("x" if j in way else t for j, t in enumerate(item)), "after"]), None, None, None))
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.start) for r in got} == want


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = contaminated(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))).collect()
    assert sorted(map(tuple, got)) == sorted(database(sf).execute(OP4_SQL).fetchall()) and got


def test_rows_that_are_kept(spark):
    docs, items = tables()
    d = spark.createDataFrame([*docs, (None, "free text without a number", None, None, None)], DOCS)
    kept = decontaminated(d, spark.createDataFrame(items, ITEMS))
    assert kept.columns == d.columns
    bad = {x[0] for x in brute(docs, items)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x for x in [*(d[0] for d in docs), None] if x not in bad), key=str)


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contaminated(d, i).collect() == [] and contaminated(spark.createDataFrame(tables()[0], DOCS), i).collect() == []
