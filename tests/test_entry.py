"""Every query with SQL gives the SQL's rows, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    cells = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.select(cells).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == 720
