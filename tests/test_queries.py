import pytest
from oracle import assert_same, connect

import __spark_entry__ as entry
from quorumlake.plans import problem_sql, problems, reference, reference_sql

QUERIES = reference.QUERIES | problems.QUERIES
SQL = reference_sql.ORACLE_SQL | problem_sql.ORACLE_SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    assert_same(spark, small, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_found_queries_return_no_row_twice(spark, small):
    for name in ("p1_found", "p3_found", "p4_found", "p6_found", "p7_found"):
        df = QUERIES[name](spark, small)
        assert df.count() == df.distinct().count(), name
