"""Queries of the training-data operators that SQL can express."""

import pytest

from tests.oracle_compare import compare, connect
from trialgauge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert ok, note
