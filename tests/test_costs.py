"""Each step of a reader is worked out once: a unit that is named in place is sought anew for each pattern behind it."""

import json

from assayframe.functions import text as t
from assayframe.functions import tokens
from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_range_token_seeks_each_unit_once(spark):
    df = spark.createDataFrame([("1 - 2",)], "s string").select(tokens.range_token(F.col("s")).alias("r"))
    assert plan_of(df).count("RLIKE") <= 2 * len(tokens.UNITS)
    assert df.first()["r"].asDict() == {"low": 1.0, "high": 2.0, "text": "1 - 2", "units": None}


def test_value_token_reads_its_text_once(spark):
    df = spark.createDataFrame([("5 H",)], "s string").select(tokens.value_token(F.col("s")).alias("v"))
    assert plan_of(df).count("regexp_replace(s") <= 1
    assert df.first()["v"].asDict() == {"numeric": 5.0, "text": None, "flag": "high"}


def test_format_range_prints_each_end_once(spark):
    rows = [(0.0625, 250.0), (None, 1e13), (-0.0004, None), (None, None), (999999999999.9999, 1234.5)]
    df = spark.createDataFrame(rows, "a double, b double").select(t.format_range(F.col("a"), F.col("b"), t.format_value).alias("r"))
    assert len(plan_of(df)) < 60_000, json.dumps(len(plan_of(df)))
    assert [r["r"] for r in df.collect()] == ["0.063–250", "≤ 10000000000000", "≥ 0", "—", "1000000000000–1234.5"]


def test_parse_makes_each_text_once(spark):
    from assayframe.operators import parsers

    head = "Diagnostic Solutions Laboratory\nBACTERIAL PATHOGENS\nH. PYLORI\nFUNGI/YEAST\n"
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return [head + "A  1  < 2\nB  2  < 3", '{"metrics":[{"name":"z","valueNumeric":2.5},{"na', "nothing"][i % 3]

    texts = spark.range(9).select(F.col("id").alias("report_id"), F.udf(text, "string")("id").alias("text"))
    rows, told = parsers.parse(texts, [parsers.panel_report(least=2), parsers.json_report()])
    assert rows.count() == 9 and sorted(r["n_rows"] for r in told.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert made.value == 9


def test_repeated_reports_are_read_together(spark):
    """Without repeats the lines of whole texts are not dealt and sorted; with them they are, as before."""
    from assayframe.operators import printed

    rows = [(1, "Zinc\n5  < 6"), (2, "Iron"), (2, "\n7  < 8")]
    one, both = (printed.read_texts(spark.createDataFrame(rows[:n], "report_id long, text string")) for n in (2, 3))
    assert [(r["report_id"], r["name"], r["numeric"]) for r in one.collect()] == [(1, "Zinc", 5.0)]
    assert sorted((r["report_id"], r["name"], r["numeric"]) for r in both.collect()) == [(1, "Zinc", 5.0), (2, "Iron", 7.0)]
    assert "Sort [" not in one._jdf.queryExecution().optimizedPlan().toString() and "Sort [" in both._jdf.queryExecution().optimizedPlan().toString()


def test_classes_of_parts(spark):
    """What the first character rules out can match none of the patterns."""
    import random

    from assayframe.functions import reports as rp

    rng = random.Random(4)
    words = [*tokens.LITERALS, "High", "l", "↑", "Zinc", "N/A", "5.0e1", "-3", "< 4", ">5", "1 - 2", "-1 - 3", "", " ", "\t", "e5", "Dl", "µ", "\u2028", "\n"]
    parts = ["", *["".join(rng.choice((w, w.upper(), w + " ", " " + w)) for w in rng.choices(words, k=rng.choice((1, 2, 3)))) for _ in range(1500)]]
    c = F.col("c")
    bare = F.trim(F.regexp_replace(F.lower(c), r"\s+(h|l|high|low|↑|↓)\s*$", ""))
    value = rp.any_of(F.trim(c), rp.VALUES) | bare.isin(*tokens.LITERALS)
    was = {"value": value, "range": rp.any_of(c, rp.RANGES), "other": rp.any_of(c, rp.NOT_NAMES), "name": ~value & ~c.rlike(r"^[<>\d]") & c.rlike("[A-Za-z]"), "ends": F.regexp_replace(c, r"^\s+|\s+$", "")}
    now = {"value": rp.is_value(c), "range": rp.is_range(c), "other": rp.is_no_name(c), "name": rp.is_name(c), "ends": tokens.squeezed_ends(c)}
    got = spark.createDataFrame([(p,) for p in parts], "c string").select("c", *[was[k].alias("was_" + k) for k in was], *[now[k].alias("now_" + k) for k in now]).collect()
    assert [(r["c"], k) for r in got for k in was if r["was_" + k] != r["now_" + k]] == [] and sum(r["was_value"] for r in got) > 100
