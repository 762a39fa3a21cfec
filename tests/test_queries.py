"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import kinds, rows_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return connection


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@needs_data
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
    assert kinds(got) == kinds(want)


@needs_data
def test_entry(spark):
    assert entry(spark).count() > 0


@needs_data
def test_plans_stay_in_the_jvm(spark):
    """No Python, no cartesian products, and flat queries never read the payload."""
    for name in ("event_density_daily", "kv_index", "facet_or_branches", "funnel_by_day",
                 "measure_rollups_sketch", "retention", "alert_events"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
    plan = queries()["event_density_daily"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
