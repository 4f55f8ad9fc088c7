"""Queries with SQL against DuckDB."""

import os

import pytest

from adloom.llm.queries import ORACLES, REGISTRY

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = REGISTRY[name](spark, SF)
    answer = db.execute(ORACLES[name])
    order = [got.columns.index(column[0]) for column in answer.description]
    rows = [tuple(row[i] for i in order) for row in got.collect()]
    assert sorted(rows, key=repr) == sorted(answer.fetchall(), key=repr)
