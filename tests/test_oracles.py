"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from testbed.compare import connect, differences
from testbed.oracles import ORACLES as ORACLE
from testbed.queries import QUERIES

WITHOUT_SQL = {"model_versions"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, small, duck):
    assert differences(QUERIES[name](spark, small), duck, ORACLE[name]) is None


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_without_sql(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    rows = entry(spark)
    assert rows.count() > 0
    assert "transaction_velocity" in rows.columns
