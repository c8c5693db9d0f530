"""Every core query with SQL gives DuckDB's rows; every other one runs."""

import os

import duckdb
import pytest

from spindrift import oracle, queries
from spindrift.flows import queries as flow_queries

SQL = oracle.oracle_sql()
ALL = queries.queries()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if v != v else repr(v + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, small, con, name):
    df = ALL[name](spark, small)
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["curate_accounting", "model_gbt_predict", "model_learning_curve", "model_linear", "treeshap_additivity", "shap_top_sources", "pso_top", "tsne_2d", "grid_draws", "file_hashes"])
def test_flows_run(spark, small, name):
    assert flow_queries()[name](spark, small).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(ALL)
