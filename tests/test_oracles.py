"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import pytest

from tests.oracle import same
from tessera.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_small, name):
    same(spark, sf_small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_small, name):
    assert QUERIES[name](spark, sf_small).columns
