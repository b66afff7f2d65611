"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(set(SQL) - {"g2_run_steps"}))
def test_same_as_sql(spark, small, connection, name):
    assert oracle.compare(spark, connection, small, queries()[name], SQL[name]) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["measure"] for r in rows} >= {"rows", "weight"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())
