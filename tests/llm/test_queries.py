"""Every query of the subpackage that has a SQL equivalent agrees with it."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracles import difference, tables  # noqa: E402

from ridgeline.llm.queries import ORACLE  # noqa: E402


@pytest.fixture(scope="module")
def con(data):
    return tables(data)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_its_sql(spark, con, data, name):
    assert difference(spark, con, data, name) is None
