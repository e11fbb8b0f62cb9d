"""Every engine query against its SQL on the smallest tables; rows and a stable schema for the rest."""

import pytest
from harness import compare, connect

from lodestone.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, con):
    compare(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and {"risk", "upstream", "downstream", "services", "hits"} == set(rows[0].asDict())
    assert set(e.oracle_sql()) <= set(e.queries())
