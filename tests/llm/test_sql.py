"""The training-data queries with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from spindrift.llm import oracle, queries

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    df = queries.queries()[name](spark, small)
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
