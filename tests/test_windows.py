from collections import Counter

import pytest

from quillspark.operators.windows import coalesce_ranges
from quillspark.plans import catalog
from tests.oracle import database, rows

SF = "/root/testdata/sf0.1"


def lines(spark, tmp_path, of):
    """A folder whose lineitem has the given suppliers, parts and line numbers."""
    spark.createDataFrame(of, "l_suppkey bigint, l_partkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def merged(spark, sf_dir):
    return Counter((r.l_suppkey, r.s, r.e, r.n) for r in coalesce_ranges(spark, sf_dir).collect())


@pytest.mark.parametrize(
    "of",
    [
        [(1, 10, -5), (1, 10, -5), (1, 10, -5), (1, 20, 1), (2, 5, -3), (2, 5, -3), (2, 5, 2)],
        [(1, 1, 2), (1, 10, None), (1, 10, 3), (1, 12, 1), (2, 4, None), (2, 4, 1), (3, 7, None), (3, 7, None), (3, 9, 1)],
        [(1, 1, 2), (1, None, 2), (1, 10, 2), (1, None, None), (2, None, 1), (3, None, 1), (3, None, 1), (None, 1, 2), (None, 9, 2)],
    ],
    ids=["reversed", "no end", "no start"],
)
def test_coalesce_ranges_of_odd_ranges(spark, tmp_path, of):
    """As the SQL has it; no two equal ranges here give different rows by which comes first."""
    sf_dir = lines(spark, tmp_path, of)
    con = database(SF)
    con.execute(f"create or replace view lineitem as select * from '{sf_dir}/lineitem.parquet/*.parquet'")
    assert rows(coalesce_ranges(spark, sf_dir).toPandas()) == rows(con.execute(catalog.ORACLE_SQL["coalesce_ranges"]).df())


def test_coalesce_ranges_of_copies(spark, tmp_path):
    """Copies that open a merged range stay together, and nothing joins the range before."""
    sf_dir = lines(spark, tmp_path, [(503, 7773, 6), (503, 7817, 1), (503, 7817, 1)])
    assert merged(spark, sf_dir) == Counter([(503, 7773, 7779, 1), (503, 7817, 7818, 2)])


def test_coalesce_ranges_against_a_walk(spark):
    want, of = Counter(), None
    for k, s, e in database(SF).execute("SELECT l_suppkey, l_partkey, l_partkey + l_linenumber FROM lineitem ORDER BY ALL").fetchall():
        if of and k == of[0] and s <= of[2] + 1:
            of = (k, of[1], max(of[2], e), of[3] + 1)
        else:
            want[of] += of is not None
            of = (k, s, e, 1)
    want[of] += 1
    assert merged(spark, SF) == +want
