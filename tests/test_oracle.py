"""Every registered query that has SQL, against DuckDB."""

import pytest

from siftwell.plans import catalog
from tests.compare import connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])
