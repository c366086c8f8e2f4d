"""Every bound query against its oracle on the smallest tables; the driver does the same on larger ones."""

import pytest

from rampwise.bindings import catalog
from tools.check import compare, connect

LEARNED = {n for n in catalog.QUERIES if n not in catalog.ORACLES}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LEARNED))
def test_query_matches_oracle(spark, con, data, name):
    ok, note = compare(spark, con, name, data)
    assert ok, note


def test_flagship_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
