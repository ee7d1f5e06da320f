"""Every registered query against its SQL statement, at the smallest scale."""

import compare
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare.difference(df, con, ORACLES[name], allow_empty=True) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
