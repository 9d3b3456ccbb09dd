"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as gate
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = gate.queries(), gate.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]) is None


def test_entry_has_rows(spark):
    df = gate.entry(spark)
    assert df.columns[:2] == ["ip", "req_count"] and df.count() > 0
