"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from scoreloom.plans import registry
from scoreloom.plans.marts import Marts
from tools.check import TABLES, plain

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(tables):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, db, tables, name):
    df = QUERIES[name](spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    relation = db.sql(SQL[name])
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_the_registry_is_in_the_entry():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("factor", ["0.001", "0.01", "0.1"])
def test_run_ids_are_unique(spark, factor):
    runs = Marts(spark, f"/root/testdata/sf{factor}").runs().select("run_id")
    assert runs.count() == runs.distinct().count()
