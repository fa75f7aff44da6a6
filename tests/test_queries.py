"""Every registered query against its SQL on the small tables."""

import pytest

from eventwarden.catalog.oracle import all_oracles
from eventwarden.catalog.queries import all_queries
from tests.compare import compare, duck

QUERIES, SQL = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(set(QUERIES) - set(SQL)) <= 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], small) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0
