import random

from pyspark.sql import functions as F

from quillspark.operators.graph import clusters, components
from quillspark.plans.evidence import dup_totals, paired, says_enough, summed
from quillspark.plans.registry import ORACLE_SQL
from tests.oracle import database, rows


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((x, find(x)) for x in root)


def test_components_of_chains_hubs_and_noise(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 180)] + [(200, i) for i in range(201, 260)] + [(i, 300) for i in range(301, 330)]
    links += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)] + [(5, 5), (None, 3), (3, None), (150, 149)] * 2
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == brute(links)
    named = [tuple(None if x is None else f"n{x:04}" for x in link) for link in links]
    assert sorted(map(tuple, components(spark.createDataFrame(named, "a string, b string")).collect())) == brute(named)
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_clusters_keep_null_sources_and_lone_documents(spark):
    units = [("s", 1, "x"), ("s", 2, "x"), ("s", 2, "y"), ("s", 3, "y"), ("t", 4, "x"), (None, 5, "z"), (None, 6, "z")]
    got = clusters(spark.createDataFrame(units, "source string, doc_id long, h string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]


def test_pairs_of_ranges(spark):
    cases = [([1, 2], [3, 4]), ([1], [3, 4, 5]), ([1, 2, 3], [9]), ([1, 2, 3], [7, 8]), ([], [1]), (None, [1])]
    want = [[(1, 3), (2, 4)], [(1, 3), (1, 4), (1, 5)], [(1, 9), (2, 9), (3, 9)], [(1, 7), (2, 8)], [], []]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<int>, b array<int>")
    got = rows.select("i", paired(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()
    assert [[tuple(x) for x in r.p] for r in got] == want


def test_short_texts_need_the_same_numbers(spark):
    cases = [("a" * 30, "b" * 40, True), ("a", "b" * 40, False), ("pay 5 of 10", "5, then 10", True), ("10 of 5", "5 of 10", False), ("none", "none", False)]
    got = spark.createDataFrame(cases, "a string, b string, want boolean").select(says_enough(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_totals_count_copies_and_members_of_classes(spark):
    docs = [("s", i, "one text that was copied\nover and over") for i in range(1000)] + [("t", 1000 + i, "\n".join(["short"] * 4)) for i in range(3)]
    docs += [("u", 2000 + i, f"a line that all of them hold{chr(10)}{'ab'[i % 2] * 12}") for i in range(5)] + [(None, 3000, None)]
    got = {r.source: tuple(r)[1:] for r in summed(spark.createDataFrame(docs, "source string, doc_id long, text string")).collect()}
    assert got == {"s": (1000, 499_500, 499_500, 499_500, 0), "t": (3, 3, 3, 3, 0), "u": (5, 10, 10, 4, 6), None: (1, 0, 0, 0, 0)}


def test_totals_against_all_pairs_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    got, want = dup_totals(spark, sf).toPandas(), database(sf).execute(ORACLE_SQL["dup_totals"]).df()
    assert rows(got) == rows(want) and got.reported.sum() > 0
