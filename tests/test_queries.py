import pytest

import __spark_entry__
from quillspark.plans import catalog
from tests.oracle import database, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "left_doc", "right_doc", "shared", "dice", "risk"]


def test_optional_parts_are_guarded():
    assert __spark_entry__._optional("quillspark.removed.registry") is None and __spark_entry__._optional("removed") is None
