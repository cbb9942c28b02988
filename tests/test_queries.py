"""Every registered query of the grid engine against its oracle; those without one must run and give rows."""

import pytest
from oracle import connection, oracle_rows, rows

from rasterloom.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, data, con, name):
    assert rows(registry.QUERIES[name](spark, data)) == oracle_rows(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
