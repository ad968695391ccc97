"""The interval join against all pairs, its plan, and the written export against the rule."""

import datetime as dt
import glob
import random

from assayframe.functions import text as t
from assayframe.operators import overlays
from assayframe.plans import charts
from assayframe.sources import sections
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def days(rng, most):
    return DAY + dt.timedelta(days=rng.randrange(most))


def test_all_pairs(spark):
    rng = random.Random(1)
    windows = [(i, a := days(rng, 400), a + dt.timedelta(days=rng.choice((0, 1, 31, 32, 33, 200, -5)))) for i in range(60)] + [(90, None, DAY), (91, DAY, None)]
    bands = [(i, a := days(rng, 700), rng.choice((None, a, a + dt.timedelta(days=rng.randrange(-10, 300))))) for i in range(80)] + [(95, None, DAY), (96, None, None)]
    w = spark.createDataFrame(windows, "w long, since date, until date")
    b = spark.createDataFrame(bands, "b long, started date, stopped date")
    pairs = overlays.overlapping_pairs(w, "since", "until", b, "started", "stopped")
    want = [(i, j) for i, since, until in windows for j, a, z in bands if None not in (since, until, a) and since <= until and a <= until and (z is None or z >= since)]
    assert sorted((r["w"], r["b"]) for r in pairs.collect()) == sorted(want)
    assert overlays.overlapping_pairs(w.limit(0), "since", "until", b, "started", "stopped").count() == 0


def test_no_nested_loop(spark):
    for query in (charts.overlay_bands, charts.overlay_marks):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_written_file(spark, tmp_path):
    """Over many partitions the files in their order hold the lines by the rule."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = [(random.Random(i).randrange(50), i) for i in range(500)]
        one = spark.createDataFrame([(k, i, f"{k},{i}") for k, i in given], "k long, i long, line string").repartition(5)
        sections.write_sections(spark, f"file://{tmp_path}/x", [("a,b", one, [F.desc("k"), "i"]), ("c", one.limit(0), ["k"]), ("d", one.where("k = 3"), ["i"])])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = sorted(glob.glob(f"{tmp_path}/x/part-*"))
    body = "".join(f"{k},{i}\n" for k, i in sorted(given, key=lambda r: (-r[0], r[1])))
    assert len(files) > 2 and "".join(open(f).read() for f in files) == "a,b\n" + body + "\nc\n\nd\n" + "".join(f"{k},{i}\n" for k, i in given if k == 3)


def test_order_of_languages(spark):
    names = ["zinc", "Äpfel", "apfel", "Apfel", "äpfel", "Zinc", "iron b", "iron a", "Iron", "iron", "éclair", "eclair", "f"]
    got = spark.createDataFrame([(x,) for x in names], "x string").orderBy(t.in_order(F.col("x"))).collect()
    assert [r["x"] for r in got] == ["apfel", "Apfel", "äpfel", "Äpfel", "eclair", "éclair", "f", "iron", "Iron", "iron a", "iron b", "zinc", "Zinc"]


def test_scans_of_the_fact(spark):
    """These read the rows of lineitem twice at most."""
    from assayframe.plans import registry

    for name, most in (("series_summary", 2), ("export_series", 2), ("extract_diff", 2), ("compare_series", 3)):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < sum("l_orderkey" in line and "Relation [" in line for line in plan.split("\n")) <= most, name
