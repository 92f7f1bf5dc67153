"""Registered queries against their SQL on the smallest data."""

import pytest

from corpusframe.plans import catalog
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    outcome = differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER)
    assert outcome in (None, "no rows")


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
