"""Every registered query against its SQL; queries without SQL must return rows.

The smallest tables have empty hours, so they exercise the gap handling.
"""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name], exact=False) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_names_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 9 and sorted(r["event_no"] for r in rows) == list(range(1, 10))
