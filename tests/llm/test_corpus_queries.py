"""The corpus queries that SQL can express, against DuckDB, and all queries' names."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as contract
from rowsieve.llm.queries import QUERIES
from rowsieve.llm.queries_sql import ORACLE_SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(row) for row in df.select(*columns).collect())
    assert got == sorted(cursor.fetchall())


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
