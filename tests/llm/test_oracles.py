"""Corpus queries against their DuckDB twins."""

import pytest

from lixora.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLES[name]) is None
