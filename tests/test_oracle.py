"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, spark_rows, sql_rows
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    names, rows = spark_rows(queries()[name](spark, SMALL))
    other_names, other = sql_rows(con, oracle_sql()[name])
    assert names == other_names
    assert rows == other


def test_only_optional_queries_have_no_sql():
    from accesslake.catalog import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 30
