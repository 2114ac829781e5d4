"""Every registered query runs; those with SQL agree with it."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_compare_finds_a_difference(spark, con):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert compare(df, con, "SELECT 1 AS a, 2.0::DOUBLE AS b") is None
    assert compare(df, con, "SELECT 1 AS a, 2.1::DOUBLE AS b") is not None
    assert compare(df, con, "SELECT 1 AS a, 2 AS b") is not None
