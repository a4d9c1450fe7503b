"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def test_names():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, db, name):
    got = entry.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    cursor = db.execute(SQL[name])
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    assert len(at) == len(cursor.description)
    expected = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
