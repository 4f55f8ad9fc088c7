"""Every registered query against its SQL in DuckDB."""

import importlib
import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("pages", "documents", "conversations")
contract = importlib.import_module("__spark_entry__")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(contract.REGISTRY) == set(contract.oracles.ORACLES)
    assert set(contract.REGISTRY) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    rows = contract.entry(spark)
    assert rows.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


@pytest.mark.parametrize("name", sorted(contract.REGISTRY))
def test_query_equals_sql(spark, db, name):
    got = contract.queries()[name](spark, SF)
    answer = db.execute(contract.oracle_sql()[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == sorted(got.columns)
    expected = answer.fetchall()
    order = [got.columns.index(n) for n in names]
    actual = [tuple(row[i] for i in order) for row in got.collect()]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)
