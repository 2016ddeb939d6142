"""Registered pipeline queries against their SQL, and models on held-out rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, db, tables, name):
    df = queries.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    relation = db.sql(queries.SQL[name])
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())


NATIVE = ["op3_mix_sources", "op6_line_dedup", "op7_exact_dedup", "op8_license_scan", "op11_chat_formatting"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, tables, name):
    plan = queries.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_language_of_held_out_documents(spark, tables):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count(F.lit(1))).first()
    assert right >= 0.97 * n


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op9_quality_classifier(spark, folder).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    ahead = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ahead >= 0.95
    assert sum(g >= 0.3 for g in good) >= 0.98 * len(good)
