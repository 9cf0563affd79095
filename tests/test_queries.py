"""Every registered query with SQL against DuckDB, on tables large enough for every branch of the SQL to have rows."""

import decimal
import os

import duckdb
import pytest

from loamline.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        at = [rel.columns.index(c) for c in names]
        assert sorted(rel.columns) == names
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["vector_topk"](spark, DATA))
    assert "WindowGroupLimit" in plan_of(QUERIES["last_n_events"](spark, DATA))
    scan = plan_of(QUERIES["file_rank"](spark, DATA))
    assert "p_brand" not in scan.split("ReadSchema")[1].split("\n")[0]
    assert "PushedFilters: [IsNotNull" in plan_of(spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderstatus = 'P'"))
