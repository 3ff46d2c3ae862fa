"""Registered queries against their SQL, as the library's own are."""

import warnings

import pytest
from llm_fixtures import sf_dir  # noqa: F401
from oracle_check import differences, oracle_connection

from tidemark.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert differences(spark, connection, queries.queries()[name], SQL[name], sf_dir) == []


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
