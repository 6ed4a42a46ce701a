"""Every registered log query against its SQL."""

import pytest

from logweir import queries, service_queries
from tests.oracle import compare, connect

QUERIES = queries.QUERIES | service_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | service_queries.ORACLE_SQL
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ts", "name", "value"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
