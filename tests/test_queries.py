"""Every core query with SQL gives what the SQL gives; the others run and have rows."""

import os

import pytest

from ratewright.plans import catalogue
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    got = sqlcheck.canonical(catalogue.QUERIES[name](spark, sqlcheck.DATA).toPandas())
    assert got == sqlcheck.canonical(con.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, sqlcheck.DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
