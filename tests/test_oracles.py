"""Every registered query with an oracle equals its DuckDB SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SMOKE
from tools.oracle_check import compare, duck_connection

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duck_connection(SMOKE)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SMOKE), con, ORACLES[name])
    assert ok, msg
