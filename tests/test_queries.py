"""Every core query against its SQL on the small test tables."""

from __future__ import annotations

import pytest

from tests.helpers import alike, views
from velotrace.plans import core, oracles, problems

QUERIES = core.queries() | problems.queries()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = alike(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).schema
