"""The SQL of the schedules on rows that the test tables lack: sources of very unequal size, nulls, repeats, ties."""

import duckdb
import pytest

from rasterloom.llm import queries


def uneven_rows():
    rows = [(i, None if i % 50 == 7 else f"text {i * 37 % 211} " * (1 + i % 9), ("hot", "warm", "mild")[(i % 10 > 5) + (i % 10 > 8)]) for i in range(700)]
    rows += [(1000 + i, "same length %02d" % i, None) for i in range(60)]
    return rows + [(None, "", "rare"), (None, "", "rare"), (5, "text é", "hot"), (5, "text é", "hot"), (-3, "你好", "once")]


@pytest.mark.parametrize("name", ["op1_pfair_mix", "op3_lpt_shards"])
@pytest.mark.parametrize("n", [0, 1, None])
def test_schedules_equal_their_sql(spark, tmp_path, name, n):
    df = spark.createDataFrame(uneven_rows()[:n], "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))
