"""Every query with an oracle equals DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
