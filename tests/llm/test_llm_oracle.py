"""The operators' queries agree with SQL."""

import pytest
from compare import connect, difference

from vacantia.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, folder, duck):
    assert difference(QUERIES[name](spark, folder), duck, ORACLES[name]) is None
