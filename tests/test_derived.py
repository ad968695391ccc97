"""Tokens of printed lines, the extraction diff and streaming ingest on small fixtures."""

from pyspark.sql import functions as F

from assayframe.functions import tokens
from assayframe.operators.diff import extract_diff
from assayframe.streaming.ingest import start_ingest


def test_value_tokens(spark):
    cases = [
        ("6.46e8", 6.46e8, None, None), ("H 6.46e8", 6.46e8, None, "high"), ("<1.00e2 <dl L", None, "<dl", "low"), ("High ↓", None, None, "low"),
        (">750", 750.0, ">750", None), ("negative", None, "Negative", None), ("trace", None, "trace", None), ("", None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", tokens.value_token(F.col("t")).alias("v"))
    got = {r["t"]: tuple(r["v"]) for r in df.collect()}
    assert got == {c[0]: c[1:] for c in cases}


def test_range_tokens(spark):
    cases = [
        ("1.6e9 - 2.5e11org/g 1.6e9 - 2.5e11", 1.6e9, 2.5e11, "1.6e9 - 2.5e11", "org/g"), ("< 10 ng/mL", None, 10.0, "< 10", "ng/mL"), (">5%", None, None, ">5%", None),  # a percent sign after a digit is no unit of its own
       
        ("> 5", 5.0, None, "> 5", None), ("Negative", None, None, "Negative", None), ("", None, None, None, None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", tokens.range_token(F.col("t")).alias("r"))
    got = {r["t"]: tuple(r["r"]) for r in df.collect()}
    assert got == {c[0]: c[1:] for c in cases}


def test_diff(spark):
    schema = "report_id long, panel string, name string, value double, value_text string, unit string, ord long"
    left = [(1, "P", "Iron", 10.0, None, "ug", 1), (1, "P", "iron", 99.0, None, "ug", 2), (1, "Q", "Zinc", 1.0, None, None, 3), (1, "R", "Zinc", 2.0, None, None, 4), (1, "P", "Lead", 5.0, None, "a", 5)]
    right = [(1, "P", "IRON ", 10.4, None, "UG", 1), (1, None, "zinc", 2.0, None, "", 2), (1, "P", "Lead", 5.0, None, "b", 3), (1, "S", "zinc", 2.0, None, None, 4), (2, None, "x", None, "t", None, 1)]
    got = sorted(tuple(r) for r in extract_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect())
    assert got == [(1, "iron", "matched"), (1, "lead", "units"), (1, "zinc", "left"), (1, "zinc", "matched"), (1, "zinc", "right"), (2, "x", "right")]


def test_stream_ingest(spark, tmp_path):
    schema = "doc_id long, text string"
    for rows in ([(1, "a"), (2, "a"), (3, None)], [(4, "a"), (5, "b"), (6, "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/cp", schema).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [1, 3, 5]
