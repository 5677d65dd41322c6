"""Queries of the training-data operators against their SQL, on a small table."""

import pytest

from tests.oracle import same
from tessera.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    same(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLES[name])
