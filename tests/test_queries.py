"""Every registered query runs; where there is SQL for it, both give the same rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, sql, name):
    frame = entry_points.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())
    oracle = entry_points.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    result = sql.execute(oracle)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(
        tuple(repr(r[names.index(c)]) for c in columns) for r in result.fetchall()
    )
    assert rows == expected
