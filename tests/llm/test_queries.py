"""Registered queries of the package against their SQL twins."""

import pytest
from check_oracle import compare, oracle_connection

import __spark_entry__ as entry
from stepfall.llm import queries

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_TINY)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries.QUERIES[name], queries.SQL[name], SF_TINY) == []


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.SQL) <= set(entry.oracle_sql())
