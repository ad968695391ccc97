"""Every measurement query against its DuckDB SQL."""

import os

import duckdb
import pytest

from assayframe.functions import text
from assayframe.plans import registry
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def cell(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    sql = con.execute(registry.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(cell, r)) for r in sql.fetchall()), key=repr)
    got = sorted((tuple(map(cell, r)) for r in df.select(*names).collect()), key=repr)
    assert got == want and got


def test_units_and_trend(spark):
    rows = [("x10E3/µL", "k/ul"), (" Organisms/g ", "copies/g"), ("", None), (None, None), ("mL/min/1.73m²", "ml/min/1.73"), ("foo", "foo")]
    df = spark.createDataFrame(rows, "u string, k string").withColumn("got", text.canonical_unit(F.col("u")))
    assert all(r["k"] == r["got"] for r in df.collect())
    cases = [([10.0, 10.0, 10.5], "flat"), ([10.0, 11.0], "up"), ([0.0, 5.0], "flat"), ([-10.0, -9.0], "up"), ([1.0], "flat"), ([], "flat")]
    df = spark.createDataFrame(cases, "h array<double>, t string").withColumn("got", text.trend(F.col("h")))
    assert all(r["t"] == r["got"] for r in df.collect())
