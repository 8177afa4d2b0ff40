import difflib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.plans import catalog
from quillspark.plans.extraction import PERCENT, label_score, pages_of, percentage, places, product_row, slug


@pytest.mark.parametrize("pattern", ["[0-9]+", "a+|bb", "é"])
def test_places_against_brute_force(spark, pattern):
    texts = ["", "none", "12 and 345", "7", "aaébb aabbbb9", "9é9é", "ééa", "x" * 5000 + "12"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", places(F.col("t"), pattern).alias("p")).collect()
    for r in got:
        assert [tuple(x) for x in r.p] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t)]


def test_percentages(spark):
    cases = {"下浮3.5%": [3.5], "12 ％，百分之五": [12.0, 5.0], "百分之三点五": [3.5], "百分之十": [10.0], "百分之十五": [15.0], "百分之二十": [20.0], "百分之九十九点零一": [99.01], "无": []}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.transform(places(F.col("t"), PERCENT), lambda x: percentage(x["said"])).alias("p")).collect()
    assert {r.t: r.p for r in got} == cases


def test_rows_that_multiply(spark):
    cases = {"1 bolt 2.5 4 10": (2.5, 4.0, 10.0, True), "x 4 250000 1000000": (250000.0, 4.0, 1000000.0, True), "9 9 9 2 3 7": (2.0, 3.0, 7.0, False), "1 2": None, "": None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", product_row(F.col("t")).alias("x")).collect()
    assert {r.t: r.x and tuple(r.x) for r in got} == cases


def test_pages_and_slugs(spark):
    d = spark.createDataFrame([('{"page": 3, "a": [{"page_no":1}, {"page":3}], "pages": 9, "page_number": 2}', " A b/Ü! "), ("{}", None), (None, "--")], "j string, n string")
    assert [(r.p, r.s) for r in d.select(pages_of(F.col("j")).alias("p"), slug(F.col("n")).alias("s")).collect()] == [([1, 2, 3], "a-b"), ([], "unnamed"), (None, "unnamed")]


def test_label_scores(spark):
    cases = [("total price", "total price", 1.0), ("total price", "total", 0.78), ("ab", "abc", difflib.SequenceMatcher(None, "ab", "abc").ratio()), ("", "x", 0.0), (None, "x", 0.0), ("abcdefghi", "abcdefgh", 8 / 9)]
    got = spark.createDataFrame(cases, "a string, b string, want double").select(label_score(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == pytest.approx(r.want) for r in got)


def test_registered_scores_are_brute_force(spark):
    for r in catalog.QUERIES["label_scores"](spark, "/root/testdata/sf0.001").collect():
        a, b = r.p_name, r.p_type
        like = difflib.SequenceMatcher(None, a, b).ratio()
        assert r.party == pytest.approx(min(1, max(like, len(set(a) & set(b)) / len(set(b))) + 0.35 * (a in b or b in a)))
