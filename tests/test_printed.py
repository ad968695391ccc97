"""The report reader, the salvage of JSON and the parsers, on fixtures with results worked out by hand."""

import pytest

from assayframe.functions import reports as rp
from assayframe.operators import parsers, printed
from pyspark.sql import functions as F

READ = ["panel", "name", "numeric", "text", "flag", "low", "high", "units"]
PHYLA, SCFA, BCFA, BILE = "Bacterial Phyla", "Short Chain Fatty Acids (SCFA)", "Branched Chain Fatty Acids (BCFA)", "Primary Bile Acids"


def read(spark, lines):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "report_id long, at long, line string")
    return [tuple(r[c] for c in READ) for r in printed.read_reports(df).orderBy("nth").collect()]


@pytest.mark.parametrize("lines,want", [
    # The last part is the range, what is between name and range belongs to the value.
    (["Species A  2.9e5  H  1.0e1 - 8.2e6"], [(None, "Species A", 2.9e5, None, "high", 10.0, 8.2e6, None)]),
    # The name goes up to the first value.
    (["BACTERIAL PHYLA", "Species B  var x  3.0e5  < 1.0e6org/g"], [(PHYLA, "Species B var x", 3.0e5, None, None, None, 1e6, "org/g")]),
    # Name, value and range in any order on three lines.
    (["Caproate", "5.0e1", "< 1.00e3"], [(None, "Caproate", 50.0, None, None, None, 1e3, None)]),
    (["6.68e-1", "Caproate", "< 1.00e3"], [(None, "Caproate", 0.668, None, None, None, 1e3, None)]),
    (["7.15e-1 - 1.44e2", "6.68e-1 L", "Caproate"], [(None, "Caproate", 0.668, None, "low", 0.715, 144.0, None)]),
    # Name and range between tabs, the value with its flag on the next line.
    (["Valerate\t< 2.0e3", "7.0e1 H"], [(None, "Valerate", 70.0, None, "high", None, 2e3, None)]),
    # Value and range before the name, and the other way round.
    (["<dl  < 1.00e3", "Species C"], [(None, "Species C", None, "<dl", None, None, 1e3, None)]),
    (["Species C", "1.0e1  L  < 1.00e3"], [(None, "Species C", 10.0, None, "low", None, 1e3, None)]),
    # Two columns under two headings; a single heading ends them.
    (["SACCHAROLYTIC STRAIGHT CHAIN FATTY ACIDS\tPROTEOLYTIC BRANCHED CHAIN FATTY ACIDS", "Acetate  1.5  1.0 - 2.0\tIsobutyrate  2.5  < 3.0", "BACTERIAL PHYLA", "A1  1  < 2\tB1  3  < 4"],
     [(SCFA, "Acetate", 1.5, None, None, 1.0, 2.0, None), (BCFA, "Isobutyrate", 2.5, None, None, None, 3.0, None), (PHYLA, "A1", 1.0, None, None, None, 2.0, None), (PHYLA, "B1", 3.0, None, None, None, 4.0, None)]),
    # Columns for abbreviation and conjugation, on one line and on two, and outside of their panels.
    (["PRIMARY BILE ACIDS Abbreviation Conjugation** Result ng/g Reference ng/g", "Chenodeoxycholic Acid  CDCA  U  1.2e1  < 5.0e1", "Total Primary  Total BA Primary  3.4  1.0 - 9.0", "Glycoursodeoxycholic Acid", "GUDCA  C  7.7  < 8.8",
      "BACTERIAL PHYLA", "Cholic Acid  CA  U  1.0  < 2.0"],
     [(BILE, "Chenodeoxycholic Acid", 12.0, None, None, None, 50.0, None), (BILE, "Total Primary", 3.4, None, None, 1.0, 9.0, None), (BILE, "Glycoursodeoxycholic Acid", 7.7, None, None, None, 8.8, None),
      (PHYLA, "Cholic Acid CA U", 1.0, None, None, None, 2.0, None)]),
    # A heading with data behind it, and one that drops the open pieces.
    (["VIRUSES  Epstein  1.0e2  < 5.0e2", "Half a row", "WORMS", "3.0e0  < 9.0"], [("Viruses", "Epstein", 100.0, None, None, None, 500.0, None)]),
    # Rows without a value go; so does a later row of a panel's name, even behind one that went.
    (["Gene X  1.0 - 2.0", "Gene Y  3.0", "Gene Y  4.0  < 5.0", "Gene Z  Positive  Negative", "gene z  Negative  Negative"], [(None, "Gene Z", None, "Positive", None, None, None, None)]),
    ([], []),
])
def test_shapes(spark, lines, want):
    assert read(spark, lines) == want


def test_reports_are_apart(spark):
    rows = [(1, 0, "Caproate"), (2, 0, "5.0e1"), (1, 1, "5.0e1"), (2, 1, "< 9"), (1, 2, None), (1, 3, "< 1.00e3"), (None, 0, "Zinc  5  < 6")]
    got = printed.read_reports(spark.createDataFrame(rows, "report_id long, at long, line string")).collect()
    assert sorted((r["report_id"] or 0, r["name"]) for r in got) == [(0, "Zinc"), (1, "Caproate")]


def test_salvage(spark):
    whole = '{"provider":"x","metrics":[{"name":"a","ref":{"low":1,"note":"}] {"}},{"name":"b \\" ]}"}'
    cases = [
        (whole + ',{"name":"cut of', whole + "]}"), (whole + ',{"name":"c","ref":{"low":2}', whole + "]}"), (whole, whole + "]}"),
        (whole + "],", None), ('{"metrics":[{"name":"cut', None), ('{"rows":[{"a":1},', None), ("no json", None), ("", None), (None, None),
        ('{"notes":[1,2],"metrics": [ {"a":[1,{"b":2}]} , {"a"', '{"notes":[1,2],"metrics": [ {"a":[1,{"b":2}]}]}'),
        ('{broken "metrics":[{"a":1},{', None), ('{"metrics":[' + '{"s":"' + "\\\\\\\"x" * 20_000 + '"},{"s":', '{"metrics":[' + '{"s":"' + "\\\\\\\"x" * 20_000 + '"}]}'),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i long, c string").withColumn("s", rp.salvaged_text(F.col("c"))).orderBy("i").collect()
    assert [r["s"] for r in got] == [w for _, w in cases]
    fenced = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), (" {\"a\": 1} ",), ("```\n" + whole + ",{",)], "c string")
    assert [r["v"] is not None for r in fenced.select(rp.answer(F.col("c")).cast("string").alias("v")).collect()] == [True, True, False]


def test_parsers(spark):
    def lines(text):
        if "bad" in text:
            raise ValueError("a bad line")
        return [{"name": n, "numeric": float(v)} for n, v in (x.split("=") for x in text.split("\n")[1:])]

    registry = [parsers.panel_report(least=2), parsers.json_report()]
    parsers.register(parsers.Parser("pairs", 3, lambda t: F.coalesce(t.startswith("PAIRS"), F.lit(False)), one=lines), registry)
    with pytest.raises(ValueError):
        parsers.register(parsers.Parser("pairs", 4, lambda t: t.isNull(), one=lines), registry)
    head = "Diagnostic Solutions Laboratory\nBACTERIAL PATHOGENS\nH. PYLORI\nFUNGI/YEAST\n"
    texts = [(1, "PAIRS\na=1\nb=2"), (2, "PAIRS\nbad"), (3, "PAIRS\nx=y"), (4, head + "A  1  < 2\nB  2  < 3"), (5, head + "A  1  < 2"),
             (6, '{"metrics":[{"name":"z","valueNumeric":2.5,"refText":"< 3","flag":"ok"},{"name":"cut'), (7, "nothing"), (8, None), (9, "PAIRS")]
    rows, told = parsers.parse(spark.createDataFrame(texts, "report_id long, text string"), registry)
    got = {r["report_id"]: (r["parser"], r["version"], r["n_rows"], r["error"]) for r in told.collect()}
    assert got[1] == ("pairs", 3, 2, None) and got[2] == (None, None, 0, "ValueError: a bad line") and got[3][0] is None and got[3][3].startswith("ValueError")
    assert got[4] == ("panel-report", 1, 2, None) and got[5] == (None, None, 0, "only 1 rows, at least 2 expected")
    assert got[6] == ("json", 1, 1, None) and got[7] == got[8] == (None, None, 0, None) and got[9] == ("pairs", 3, 0, None)
    assert sorted((r["report_id"], r["nth"], r["name"], r["numeric"], r["flag"]) for r in rows.collect()) == [
        (1, 0, "a", 1.0, None), (1, 1, "b", 2.0, None), (4, 0, "A", 1.0, None), (4, 1, "B", 2.0, None), (6, 0, "z", 2.5, "ok")]
