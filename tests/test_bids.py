import difflib
import random
import re

import duckdb
import pytest

from quillspark.plans.bids import bidder_name, company_score, distinct_tables, first_kept, similar_tables, table_duplicates
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def walk(tables):
    """By definition: in order, against those that stay."""
    out, kept = [], {}
    for g, seq, page, text in sorted(tables, key=lambda t: (str(t[0]), t[1])):
        s = re.sub("[^0-9A-Za-z一-鿿]+", "", text or "").lower()
        near = lambda a, b: a == b or (min(len(a), len(b)) >= 8 and (a in b or b in a or difflib.SequenceMatcher(None, a[:400], b[:400]).ratio() >= 0.9))
        if s and any(near(x, s) for x in kept.get((g, page), [])):
            continue
        kept.setdefault((g, page), []).extend([s] if s else [])
        out.append((g, seq))
    return sorted(out, key=str)


def test_tables_that_stay(spark):
    rng = random.Random(3)
    words = ["序号", "name", "price total", "quantity 3", "甲乙丙丁", "unit"]
    tables = [(rng.choice(["d", "e", None]), i, rng.randrange(2), "|".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(60)] + [("d", 90, None, "a table without a page"), ("d", 91, 1, None), ("d", 92, None, "A table, without a page")]
    got = distinct_tables(spark.createDataFrame(tables, "g string, seq int, page int, text string"), "g").collect()
    assert sorted(map(tuple, got), key=str) == walk(tables)
    assert distinct_tables(spark.createDataFrame([], "g string, seq int, page int, text string"), "g").isEmpty()


def test_tables_of_conversations(spark):
    rows = duckdb.sql(f"select conv_id, turn, 1, text from '{SF}/conversations.parquet'").fetchall()
    assert sorted(map(tuple, table_duplicates(spark, SF).collect()), key=str) == walk(rows)


def test_chains_are_walked_in_order(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(6)], "g int, seq int")
    links = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "g int, a int, b int")
    assert sorted(r.seq for r in first_kept(nodes, links, ["g"]).collect()) == [0, 2, 4]


def test_tables_of_rows_that_are_alike(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc string, t int, i int, text string")
    left = make([("d", 1, 0, "pump of ten litres"), ("d", 1, 1, "valve in brass"), ("d", 1, 2, "valve in brass"), ("d", 2, 0, "nothing like it"), ("d", 3, 0, ""), ("e", 1, 0, None)])
    right = make([("d", 7, 0, "pump of two litres"), ("d", 7, 1, "valve in brass"), ("d", 7, 2, "valve in brasses"), ("d", 8, 0, "valve in brass"), ("d", 8, 1, "copper wire"), ("e", 1, 0, "x")])
    got = {(r.doc, r.l, r.r): round(r.score, 6) for r in similar_tables(left, right, "doc").collect()}
    assert got == {("d", 1, 7): 1.0}
    assert similar_tables(left.limit(0), right, "doc").isEmpty()


def test_seals_name_bidders(spark):
    assert [tuple(r) for r in bidder_name(spark, SF).collect()] == [(1, "杭州甲乙科技有限公司", 1.0)]
    cases = [("甲乙公司", "甲乙公司"), ("甲乙公司", "丙"), ("", "x"), (None, None), ("甲乙丙", "丙乙甲")]
    got = spark.createDataFrame(cases, "a string, b string").select(company_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([1.0, 0.0, 0.0, 0.0, 1.0])
