"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tickframe.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        assert math.isfinite(v)
        return repr(round(v, 9) + 0.0)
    return str(v)


def bag(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else v for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = bag([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    sql = ORACLES.get(name)
    if sql is None:
        assert rows
        return
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert rows == bag([tuple(plain(r[i]) for i in place) for r in answer.fetchall()])


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 150 and df.where("sma is not null").count() == 55


def test_only_unexpressible_queries_go_without_sql():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {
        "save_model", "random_forest_regression", "supervised_window_forecast", "arma_fit", "sarima_fit",
        "forecast_all_models", "forest_grid_search", "forest_random_search",
    }
