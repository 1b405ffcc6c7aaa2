"""Every registered query against its SQL twin on the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in sorted(os.listdir(SF_DIR)):
        if file.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield connection
    connection.close()


def in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sql):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    found = [tuple(row) for row in result.select([f"`{c}`" for c in columns]).collect()]
    answer = sql.execute(ORACLE[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()]
    assert in_order(found) == in_order(expected)


def test_entry_is_the_nested_mart(spark):
    from scanledger.schema import MART

    result = contract.entry(spark)
    assert result.columns == MART.fieldNames()
    assert result.count() > 0
