"""Every query of the core that has a SQL equivalent agrees with it."""

import pytest
from oracles import difference, tables

import __spark_entry__ as entry

NAMES = [n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit() and n[2] == "_" and n[1] not in "25")]


@pytest.fixture(scope="module")
def con(data):
    return tables(data)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, data, name):
    assert difference(spark, con, data, name) is None
