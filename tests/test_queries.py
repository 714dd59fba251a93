"""Every registered query of the library, against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tellurion.plans import registry

from .oracle import SF, connect, same_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert registry.queries().keys() <= e.queries().keys()
