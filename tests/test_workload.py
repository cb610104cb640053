"""Every named query against its DuckDB equivalent."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from rowsieve.plans.workload import QUERIES
from rowsieve.plans.workload_sql import ORACLE_SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Failed and total rows at sf0.01, worked out from the rules beforehand.
KNOWN_COUNTS = {
    "completeness_gaps": [(6002, 10000)],
    "completeness_full": [(0, 15000)],
    "uniqueness_single": [(0, 15000)],
    "uniqueness_text": [(73, 1000)],
    "uniqueness_null_keys": [(9950, 10000)],
    "uniqueness_composite": [(14168, 60000)],
    "validity_regex": [(19, 250)],
    "validity_enum": [(5088, 15000)],
    "validity_dtype_int": [(5713, 10000)],
    "validity_dtype_float": [(2856, 10000)],
    "validity_dtype_str": [(1428, 10000)],
    "validity_dtype_bool": [(1428, 10000)],
    "validity_range": [(275, 1500)],
    "validity_range_open": [(4787, 60000)],
    "validity_range_text": [(4285, 10000)],
    "validity_aliases": [(14840, 15000), (13493, 15000), (14845, 15000), (3750, 15000)],
    "validate_orders": [
        (0, 15000), (0, 15000), (5088, 15000), (2978, 15000), (0, 15000), (0, 0),
    ],
    "skipped_rule": [(0, 0), (0, 15000)],
    "custom_check": [(1029, 2000)],
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return sorted(tuple(normal(row[place]) for place in order) for row in rows)


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = df.collect()
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert as_rows(df.columns, got) == as_rows(columns, cursor.fetchall())
    if name in KNOWN_COUNTS and SF_DIR.endswith("sf0.01"):
        ordered = sorted(got, key=lambda row: row["rule_position"])
        assert [(row["failed_count"], row["total_count"]) for row in ordered] == KNOWN_COUNTS[name]


def test_entry(spark):
    assert contract.entry(spark).count() == 6
