from __future__ import annotations

import pytest
from compare import connection, difference

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and df.columns[0] == "user_id"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), ORACLES[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
