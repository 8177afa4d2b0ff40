import difflib
import itertools

import duckdb
import pytest

from quillspark.functions.strings import amount_of_capitals
from quillspark.operators.matching import best_match_line, classes, fuzzy_greedy, greedy, greedy_nn, matched_texts, similar_sets
from quillspark.plans import duplicates
from quillspark.plans.duplicates import dup_lines, dup_links, dup_pairs, line_units, shared_units, sharing_pairs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def walk(edges, key):
    """The greedy matching by definition: best first, each end once."""
    out, a_used, b_used = [], set(), set()
    for e in sorted(edges, key=key):
        if e[0] not in a_used and e[1] not in b_used:
            out.append(e)
            a_used.add(e[0])
            b_used.add(e[1])
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, least):
    import random

    rng = random.Random(7)
    rows = [(None if i % 9 == 0 else f"g{i % 2}", i, sorted({*rng.sample("abcdefgh", rng.randint(0, 6)), *("hot" for _ in range(i % 2))})) for i in range(90)]
    rows += [("g0", 200, None)]
    got = similar_sets(spark.createDataFrame(rows, "g string, k long, s array<string>"), "g", "k", least).collect()
    want = set()
    for (g, i, s), (h, j, t) in itertools.combinations([r for r in rows if r[2]], 2):
        if g == h and len({*s} & {*t}) >= least * len({*s} | {*t}) - 1e-9:
            want.add((g, i, j, len({*s} & {*t})))
    assert {(r.g, r.l, r.r, r.shared) for r in got} == want and len(got) == len(want) > 0


def test_sets_of_empty_tables_and_equal_sets(spark):
    none = spark.createDataFrame([], "g string, k long, s array<string>")
    assert similar_sets(none, "g", "k", 0.5).isEmpty() and classes(none, "g", "k").isEmpty()
    some = spark.createDataFrame([(None, 3, ["a", "b"]), (None, 1, ["b", "a"]), ("x", 2, ["a", "b"])], none.schema)
    assert {(r.k, r.class_id) for r in classes(some, "g", "k").collect()} == {(3, 1), (1, 1), (2, 2)}


def test_frequent_lines_make_pairs_too(spark):
    docs = spark.createDataFrame([("s", i, "a line that stands everywhere\n" + f"and one of its own {i}") for i in range(30)] + [(None, 99, None)], "source string, doc_id long, text string")
    assert shared_units(line_units(docs), 0.5).count() == 30 * 29 / 2


@pytest.mark.parametrize("least,enough", [(0.08, 5), (0.3, 3), (0.9, 2)])
def test_sets_that_share_enough_against_all_pairs(spark, least, enough):
    import random

    rng = random.Random(11)
    rows = [(f"g{i % 2}", i, sorted({*rng.sample([f"v{j}" for j in range(60)], rng.randint(1, 25)), *("hot" for _ in range(i % 3))})) for i in range(90)]
    got = similar_sets(spark.createDataFrame(rows, "g string, k long, s array<string>"), "g", "k", least, enough).collect()
    want = set()
    for (g, i, s), (h, j, t) in itertools.combinations(rows, 2):
        n = len({*s} & {*t})
        if g == h and n and (n >= enough or n >= least * len({*s} | {*t}) - 1e-9):
            want.add((g, i, j, n))
    assert {(r.g, r.l, r.r, r.shared) for r in got} == want and len(got) == len(want) > 0


@pytest.mark.parametrize("block", [256, 7])
def test_pairs_of_one_shared_line(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    docs = [("s", i, "a line that stands everywhere\n" + "\n".join(f"line of some {j}" for j in range(6) if i >> j & 1)) for i in range(60)] + [(None, 99, None), (None, None, "a line that stands everywhere"), ("s", 100, docs_like(0))]
    sets = {}
    for s, d, t in docs:
        if t and d is not None:
            sets.setdefault((s, frozenset(x.replace(" ", "") for x in t.split("\n") if len(x) > 9)), d)
    want = {(s, *sorted((a, b)), len(x & y)) for ((s, x), a), ((t, y), b) in itertools.combinations(sets.items(), 2) if s == t and x & y}
    got = sharing_pairs(line_units(spark.createDataFrame(docs, "source string, doc_id long, text string"))).collect()
    assert {(r.source, r.left_doc, r.right_doc, r.shared) for r in got} == want and len(got) == len(want)


def docs_like(i):
    return "a line that stands everywhere\n" + "\n".join(f"line of some {j}" for j in range(6) if i >> j & 1)


def test_links_and_lines_leave_no_pair_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs = duckdb.sql(f"select source, doc_id, text from '{sf}/documents.parquet'").fetchall()
    sets = {}
    for source, doc, text in docs:
        units = frozenset(y for x in (text or "").split("\n") if len(y := x.translate({32: None, 9: None, 13: None})) >= 10)
        if units:
            sets[source, units] = min(doc, sets.get((source, units), doc))
    want, low = {}, set()
    for ((s, x), l), ((t, y), r) in itertools.combinations(sorted(sets.items(), key=lambda i: i[1]), 2):
        if s == t and (n := len(x & y)):
            dice = 2 * n / (len(x) + len(y))
            risk = "high" if dice >= 0.35 and n >= 5 else "medium" if dice >= 0.15 or n >= 5 else "low"
            if risk == "low":
                low.add((l, r))
            else:
                want[l, r] = risk
    assert {(r.left_doc, r.right_doc): r.risk for r in dup_links(spark, sf).collect()} == want
    every = {(r.left_doc, r.right_doc): r.risk for r in dup_pairs(spark, sf).collect()}
    assert every == want | dict.fromkeys(low, "low")
    held = {}
    for r in dup_lines(spark, sf).collect():
        held.setdefault((r.source, r.h), []).append(r.class_id)
    assert {tuple(sorted(p)) for k in held.values() for p in itertools.combinations(k, 2)} == low | set(want) and low


def test_greedy_is_the_walk(spark):
    edges = [(a, b, float((a * 7 + b * 3) % 5)) for a in range(6) for b in range(7) if (a + b) % 3]
    got = greedy(spark.createDataFrame([("p", *e) for e in edges] + [(None, 1, 1, 0.0)], "g string, a int, b int, d double"), ["g"], [F.col("d"), F.col("a"), F.col("b")])
    assert sorted((r.a, r.b) for r in got.where("g = 'p'").collect()) == sorted((a, b) for a, b, _ in walk(edges, lambda e: (e[2], e[0], e[1])))
    assert got.where("g is null").count() == 1
    assert greedy(spark.createDataFrame([], "g string, a int, b int"), ["g"], [F.col("a"), F.col("b")]).isEmpty()


def test_fuzzy_greedy_against_all_pairs(spark):
    got = {(r.conv_id, r.a, r.b, round(r.ratio, 9)) for r in fuzzy_greedy(spark, SF).collect()}
    rows = duckdb.sql(f"select conv_id, role, turn, text from '{SF}/conversations.parquet'").fetchall()
    lines = [(c, role, t * 100_000 + p, x) for c, role, t, text in rows if text for p, x in enumerate(text.split("\n")) if x]
    want = set()
    for conv in {x[0] for x in lines}:
        mine = [x for x in lines if x[0] == conv]
        edges = []
        for _, _, i, x in (m for m in mine if m[1] == "user"):
            for _, _, j, y in (m for m in mine if m[1] == "assistant"):
                if x != y and 2 * min(len(x), len(y)) >= 0.5 * (len(x) + len(y)) and (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.5:
                    edges.append((i, j, r))
        want |= {(conv, a, b, round(r, 9)) for a, b, r in walk(edges, lambda e: (-e[2], -e[0], -e[1]))}
    assert len(got & want) >= 0.97 * max(len(got), len(want))  # at 0.5 a pair of texts may share few character pairs


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_fuzzy_greedy_equals_all_pairs(spark, sf):
    path = SF.replace("0.001", sf)
    got = sorted((r.conv_id, r.a, r.b, round(r.ratio, 9)) for r in fuzzy_greedy(spark, path).collect())
    rows = duckdb.sql(f"select conv_id, role, turn, text from '{path}/conversations.parquet'").fetchall()
    sides = {}
    for c, role, t, text in rows:
        for p, x in enumerate((text or "").split("\n")):
            if x:
                sides.setdefault(c, {}).setdefault(role, []).append((t * 100_000 + p, x))
    want = []
    for c, by in sides.items():
        edges = []
        for i, x in by.get("user", []):
            for j, y in by.get("assistant", []):
                if x != y and 4 * min(len(x), len(y)) >= len(x) + len(y):
                    m = difflib.SequenceMatcher(None, x, y)
                    if m.quick_ratio() >= 0.5 and (r := m.ratio()) >= 0.5:
                        edges.append((i, j, r))
        want += [(c, a, b, round(r, 9)) for a, b, r in walk(edges, lambda e: (-e[2], -e[0], -e[1]))]
    assert got == sorted(want) and got


def test_fuzzy_ties_and_nulls(spark):
    make = lambda rows: spark.createDataFrame(rows, "g string, i long, text string")
    left = make([("x", 0, "delivery within ten days"), ("x", 1, "delivery within ten days"), ("x", 2, None), ("x", 3, ""), ("y", 0, "alone")])
    right = make([("x", 0, "delivery within two days"), ("x", 1, "delivery within ten days")])
    assert [(r.g, r.a, r.b) for r in matched_texts(left, right, "g", 0.78).collect()] == [("x", 1, 0)]


def test_nearest_marks(spark):
    rows = greedy_nn(spark, SF).collect()
    assert rows and len({(r.page, r.a) for r in rows}) == len({(r.page, r.b) for r in rows}) == len(rows) and all(r.distance <= 10 for r in rows)


def test_best_line_against_all_lines(spark):
    rows = duckdb.sql(f"select conv_id, role, turn, text from '{SF}/conversations.parquet'").fetchall()
    grams = lambda t: {t} if len(t) <= 2 else {t[i : i + 2] for i in range(len(t) - 1)}
    said = {(c, t): x for c, r, t, x in rows if r == "assistant"}
    want = {}
    for c, r, t, x in rows:
        if r == "user" and x is not None and (lines := [(i, y) for i, y in enumerate((said.get((c, t + 1)) or "").split("\n")) if y]):
            want[c, t] = max(lines, key=lambda p: (round(len(grams(x) & grams(p[1])) / len(grams(p[1])) + 0.45 * (p[1] in x), 9), -p[0]))[0]
    assert {(r.conv_id, r.turn): r.at for r in best_match_line(spark, SF).collect()} == want


def test_capital_amounts(spark):
    cases = {"壹佰贰拾万元整": 1_200_000, "伍角": 0.5, "万元": None, "壹万亿元": 1e12, "叁亿零伍佰万零柒元贰角壹分": 305_000_007.21, "abc": None, "": None, None: None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", amount_of_capitals(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases
