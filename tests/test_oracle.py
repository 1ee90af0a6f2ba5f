"""Every registered query that has oracle SQL equals DuckDB on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()
# Stream runs are slow for their size; tests/test_streaming.py covers them.
NAMES = sorted(n for n in ORACLE if not n.startswith("stream_"))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    yield connection
    connection.close()


def rows(table):
    return sorted(map(repr, table.select(sorted(table.column_names)).to_pylist()))


def kinds(table):
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, duck, name):
    got, expected = QUERIES[name](spark, SF_DIR).toArrow(), duck.sql(ORACLE[name]).to_arrow_table()
    assert kinds(got) == kinds(expected)
    assert rows(got) == rows(expected)


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
