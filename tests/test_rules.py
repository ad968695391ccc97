"""Rules of series, diff, proposals and report lines on small fixtures with results worked out by hand."""

import datetime as dt

from assayframe.functions import reports as rp
from assayframe.functions import text as t
from assayframe.functions import tokens
from assayframe.operators import diff, facts, mapping, printed
from assayframe.operators.ranking import numbered
from pyspark.sql import functions as F

ROW = "canonical string, unit_key string, units string, value double, ref_low double, ref_high double, report_date date, uploaded_at timestamp, provider string, report_id long, ord struct<l_orderkey:long,l_linenumber:int,l_partkey:long,l_suppkey:long>"


def series_rows(spark, rows):
    day = lambda n: dt.date(2024, 1, n)
    out = [(c, u, raw, v, lo, hi, day(d), dt.datetime(2024, 2, up), "p", i, (i, 1, 1, 1)) for i, (c, u, raw, v, lo, hi, d, up) in enumerate(rows)]
    return spark.createDataFrame(out, ROW)


def test_unit_partition(spark):
    factors = spark.createDataFrame([("baso", "k/ul", 1.0, "k/µL"), ("baso", "cells/ul", 0.001, "k/µL")], "canonical string, unit_key string, factor double, display_unit string")
    rows = series_rows(spark, [
        ("baso", "cells/ul", "cells/uL", 50.0, 0.0, 200.0, 1, 1), ("baso", "k/ul", "x10E3/uL", 0.04, 0.0, 0.2, 2, 1), ("baso", "%", "%", 0.8, None, None, 3, 1),
        ("wbc", "k/ul", "Thousand/uL", 5.5, None, None, 1, 1), ("wbc", "k/ul", "x10E3/uL", 6.2, None, None, 2, 1), ("wbc", "/hpf", "/HPF", 2.0, None, None, 3, 1),
        ("hcy", "umol/l", "umol/L", 8.0, None, None, 1, 1), ("hcy", None, None, 9.2, None, None, 2, 1),
        ("odd", None, None, 1.0, None, None, 1, 1), ("odd", None, None, 2.0, None, None, 2, 1), ("odd", "a", "a", 3.0, None, None, 3, 1), ("odd", "b", "b", 4.0, None, None, 4, 1),
    ])
    got = facts.partition_units(rows, factors, F.struct("report_date", "ord")).orderBy("report_id").collect()
    assert [r["excluded"] for r in got] == [False, False, True, False, False, True, False, False, False, False, True, True]
    assert [(round(r["rescaled"], 6), r["low"], round(r["high"], 6), r["value"], r["ref_high"]) for r in got[:2]] == [(0.05, 0.0, 0.2, 50.0, 200.0), (0.04, 0.0, 0.2, 0.04, 0.2)]


def test_same_date(spark):
    rows = series_rows(spark, [("m", "u", "u", 1.0, None, None, 1, 1), ("m", "u", "u", 2.0, None, None, 1, 3), ("m", "u", "u", 3.0, None, None, 1, 2), ("m", "u", "u", 4.0, None, None, 2, 1), ("m", "u", "u", 4.0, None, None, 2, 2)])
    rows = rows.withColumns({"rescaled": F.col("value"), "low": F.col("ref_low"), "high": F.col("ref_high"), "display_unit": F.lit(None).cast("string")})
    points = {r["report_date"].day: (r["value"], r["others"], r["conflict"]) for r in facts.date_dedupe(rows).collect()}
    assert points == {1: (2.0, 2, True), 2: (4.0, 1, False)}
    assert sorted((r["place"], r["value"]) for r in facts.discarded(rows).collect()) == [(1, 3.0), (2, 1.0)]


def test_resolve_with_repeated_aliases(spark):
    aliases = spark.createDataFrame([("a", "", "x"), ("a", "", "w"), ("a", "lab", "y"), ("b", "other", "z")], "alias string, alias_provider string, canonical string")
    rows = spark.createDataFrame([("a", "lab"), ("a", "none"), ("a", None), ("b", "lab")], "key string, provider string")
    assert sorted(map(str, ((r["key"], r["provider"], r["canonical"]) for r in facts.resolve(rows, aliases).collect()))) == sorted(map(str, [("a", "lab", "y"), ("a", "none", "w"), ("a", None, "w"), ("b", "lab", None)]))


def test_values_equal(spark):
    cases = [(1.0, 1.05, None, None, True), (1.0, 1.1, None, None, False), (5.0, 5.0, "5 (high)", None, False), (None, None, "Positive", "positive", True), (None, None, None, None, True), (0.0, 0.0, None, None, True), (1.0, None, None, None, False), (1.0, 2.0, "", "", False)]
    df = spark.createDataFrame(cases, "x double, y double, s string, t string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", diff.values_equal(F.col("x"), F.col("y"), F.col("s"), F.col("t"))).collect())


def test_display(spark):
    cases = [(100.0, "100", "100"), (99.5, "99.5", "99.5"), (1.2345, "1.234", "1.2345"), (12345678.0, "12345678", "12345678"), (0.0001, "0", "0.0001"), (5.0, "5", "5")]
    df = spark.createDataFrame(cases, "v double, shown string, js string")
    assert all((r["a"], r["b"]) == (r["shown"], r["js"]) for r in df.select("*", t.format_value(F.col("v")).alias("a"), t.js_number(F.col("v")).alias("b")).collect())
    tags = spark.createDataFrame([('["a",1,"b"]', ["a", "b"]), ("{bad", []), (None, []), ('{"x":1}', [])], "s string, want array<string>")
    assert all(r["want"] == r["got"] for r in tags.withColumn("got", t.coerce_tags(F.col("s"))).collect())


def test_proposals(spark):
    new = "struct<name:string,category:string,tags:array<string>,description:string,units:string>"
    rows = [(" Foo ", "map_existing", "nothing", None, 0.9, None), ("bar", "create_new", None, ("Nothing", "bogus", ["longevity", "zap"], "Mold marker", None), 0.8, None),
            ("escherichia SPP.", "map_existing", "ecoli", None, 0.7, None), ("baz", "skip", None, None, 0.1, "no idea"), ("baz", "map_existing", "ECOLI", None, 0.5, None)]
    p = spark.createDataFrame(rows, f"raw string, action string, target string, new {new}, confidence double, reason string")
    stored = mapping.ingested(p, spark.createDataFrame([("Ecoli",)], "canonical string"))
    by = {r["key"]: r for r in stored.collect()}
    assert (by["foo"]["action"], by["baz"]["action"], by["baz"]["target"]) == ("skip", "map_existing", "Ecoli")
    assert (by["bar"]["new"]["category"], by["bar"]["new"]["tags"], by["bar"]["reason"]) == ("other", ["longevity"], 'category "bogus" coerced to "other" · dropped unknown tag(s): zap')
    fixed = {r["key"]: r for r in mapping.healed(mapping.without_lossy(stored)).withColumn("better", F.when(F.col("new").isNotNull(), mapping.better_category(F.col("new")))).collect()}
    assert set(fixed) == {"bar", "escherichia spp.", "baz"}
    assert (fixed["bar"]["extra"], fixed["bar"]["better"]) == (["foo"], "mycotoxins")
    assert (fixed["escherichia spp."]["action"], fixed["escherichia spp."]["target"]) == ("create_new", "Escherichia spp.")


def test_report_lines(spark):
    lines = ["Collected: 3/7/2024", "PATHOGENS", "BACTERIAL PHYLA", "Species A  2.9e5  1.0e1 - 8.2e6org/g 1.0e1 - 8.2e6", "Species B  <1.00e2 <dl L  1.0e3 - 5.0e8org/g", "Species C", "1.07e10  1.6e9 - 2.5e11org/g",
             "the words of this long line are prose", "Species A  7  1 - 2", "VIRUSES", "Species A  not detected  Negative", "12"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "report_id long, at long, line string")
    got = sorted((r["panel"], r["name"], r["numeric"], r["text"], r["flag"], r["low"], r["high"], r["units"]) for r in printed.read_reports(df).collect())
    assert got == [("Bacterial Phyla", "Species A", 2.9e5, None, None, 10.0, 8.2e6, "org/g"), ("Bacterial Phyla", "Species B", None, "<dl", "low", 1e3, 5e8, "org/g"),
                   ("Bacterial Phyla", "Species C", 1.07e10, None, None, 1.6e9, 2.5e11, "org/g"), ("Viruses", "Species A", None, "Not Detected", None, None, None, None)]
    names = [("Lead Lead", "Lead"), ("Protein (EDN,", "Protein"), ("Total Total Iron,", "Total Iron"), ("Zinc", "Zinc")]
    cleaned = spark.createDataFrame(names, "raw string, want string").withColumn("got", rp.clean_name(F.col("raw")))
    assert all(r["want"] == r["got"] for r in cleaned.collect())
    words = spark.createDataFrame([("not detected.", "Not Detected"), ("DETECTED", "Detected")], "s string, want string")
    assert all(r["want"] == r["v"]["text"] for r in words.withColumn("v", tokens.value_token(F.col("s"))).collect())


def test_numbered(spark):
    keys = ["", "a", "ab", "abc", "abcd", "b", "zz", "é"]
    got = numbered(spark.createDataFrame([(k,) for k in reversed(keys)], "k string"), "k").collect()
    assert sorted((r["place"], r["k"]) for r in got) == [(i + 1, k) for i, k in enumerate(sorted(keys, key=lambda x: x.encode()))]
