"""The report store: folding, batches that fail and are repeated, replays, and mappings, on fixtures worked out by hand."""

import datetime as dt
import json

import pytest

from assayframe.operators import ingest
from assayframe.sources import store as st
from pyspark.sql import functions as F

ROWS = "file_hash string, nth long, " + st.ITEM
HEAD = st.HEADERS


@pytest.fixture
def store(spark, tmp_path):
    return st.ReportStore(spark, f"file://{tmp_path}/store")


def header(spark, *reports):
    out = [(f"/in/{h}.pdf", h, p, "blood", dt.date(2024, 1, 1), "panel-report", "deterministic", 1, raw) for h, p, raw in reports]
    return spark.createDataFrame(out, HEAD)


def item(name, panel=None, value=None, text=None, units=None, low=None, high=None, flag=None):
    return (name, panel, value, text, units, low, high, None, flag)


def rows(spark, by):
    return spark.createDataFrame([(h, i, *x) for h, items in by.items() for i, x in enumerate(items)], ROWS)


def metrics(store):
    got = store.current("metrics").join(store.current("reports").select("report_id", "file_hash"), "report_id")
    return sorted((r["file_hash"], r["nth"], r["name"], r["value"], r["canonical"]) for r in got.collect())


def counts(store):
    return {t: store.current(t).count() for t in st.SCHEMAS}


def test_fold(spark):
    given = [item("Iron ", value=1.0, text="Trace ", units="mcg/dL", high=9.0), item("iron", value=1.0, text="trace", units="ug/dl", low=2.0, high=8.0, flag=""), item("IRON", value=1.0, text=" TRACE", units="ug/dL", low=3.0, high=9.0, flag="high"),
             item("iron", value=2.0, text="trace", units="ug/dl"), item("iron", value=1.0, units="ug/dl"), item("iron", value=1.0, text="", units="ug/dl", low=5.0), item("iron")]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(given)], "r long, nth long, " + st.ITEM)
    got = ingest.folded(df, ["r"], "nth", "name", "units", "value", "value_text", "ref_low", "ref_high", "flag").orderBy("nth").collect()
    assert [(r["nth"], r["name"], r["ref_low"], r["ref_high"], r["flag"], r["dropped"], r["disagreed"]) for r in got] == [
        (0, "Iron ", 2.0, 9.0, "high", 2, 2), (3, "iron", None, None, None, 0, 0), (4, "iron", 5.0, None, None, 1, 0), (6, "iron", None, None, None, 0, 0)]


def test_ingest_once(spark, store):
    head = header(spark, ("a", "labcorp", "{}"), ("b", None, "{}"), (None, "x", "{}"))
    body = rows(spark, {"a": [item("Zinc", "P", 1.0), item("zinc ", "Q", 1.0, low=3.0), item("Iron", "Q", 2.0)], "b": [], "nobody": [item("x")]})
    assert store.ingest("one", head, body)
    assert counts(store) == {"reports": 2, "extractions": 2, "panels": 2, "metrics": 2, "aliases": 0}
    assert sorted(r["metric_count"] for r in store.current("extractions").collect()) == [0, 2]
    before = metrics(store)
    assert not store.ingest("one", head, body) and metrics(store) == before
    assert store.ingest("two", header(spark, ("a", "other", "{}"), ("c", "quest", "{}")), rows(spark, {"a": [item("new")], "c": [item("Iron", value=3.0)]}))
    assert [m[:4] for m in metrics(store)] == [("a", 0, "Zinc", 1.0), ("a", 2, "Iron", 2.0), ("c", 0, "Iron", 3.0)]
    with pytest.raises(ValueError):
        store.write("../x", {})


def test_failure_between_tables(spark, store, monkeypatch):
    """A batch that fails between two tables isn't seen; repeated, with other rows even, it is seen once and whole."""
    store.ingest("one", header(spark, ("a", "labcorp", "{}")), rows(spark, {"a": [item("Zinc", "P", 1.0)]}))
    before, held = metrics(store), counts(store)
    write = st.ReportStore._write_table

    def fails(self, name, batch, out):
        if name == "metrics":
            raise OSError("lost")
        write(self, name, batch, out)

    head = header(spark, ("b", "quest", "{}"), ("c", "quest", "{}"))
    monkeypatch.setattr(st.ReportStore, "_write_table", fails)
    with pytest.raises(OSError):
        store.ingest("two", head, rows(spark, {"b": [item("Lost", "P", 1.0)], "c": [item("Lost", "P", 1.0)]}))
    assert metrics(store) == before and counts(store) == held
    monkeypatch.setattr(st.ReportStore, "_write_table", write)
    assert store.ingest("two", header(spark, ("b", "quest", "{}")), rows(spark, {"b": [item("Kept", "R", 2.0)]}))
    assert metrics(store) == [*before, ("b", 0, "Kept", 2.0, None)]
    assert counts(store) == {"reports": 2, "extractions": 2, "panels": 2, "metrics": 2, "aliases": 0}
    # A replay that fails leaves the report as it was.
    monkeypatch.setattr(st.ReportStore, "_write_table", fails)
    with pytest.raises(OSError):
        store.replace("three", store.current("reports").where("file_hash = 'b'").drop("file_path", "file_hash").withColumns({"model": F.lit("m"), "extractor_kind": F.lit("k"), "extractor_version": F.lit(2), "raw": F.lit("{}")}),
                      store.current("metrics").limit(0))
    monkeypatch.setattr(st.ReportStore, "_write_table", write)
    assert metrics(store) == [*before, ("b", 0, "Kept", 2.0, None)]


def test_replay_and_replace(spark, store):
    raw = json.dumps({"report": {"provider": "quest", "category": "gi", "reportDate": "2024-05-06", "metrics": [{"name": "Zinc", "panel": "P", "valueNumeric": 5.0}, {"name": "Zinc", "panel": "P", "valueNumeric": 5.0}, {"name": "Iron"}]}})
    store.ingest("one", header(spark, ("a", "labcorp", raw), ("b", "labcorp", "no json"), ("c", "labcorp", raw)), rows(spark, {x: [item("Old", "O", 1.0)] for x in "abc"}))
    ids = store.current("reports").where("file_hash <> 'c'").select("report_id")
    assert store.replay("again", ids) and not store.replay("again", ids)
    assert [m[:4] for m in metrics(store)] == [("a", 0, "Zinc", 5.0), ("a", 1, "Zinc", 5.0), ("a", 2, "Iron", None), ("b", 0, "Old", 1.0), ("c", 0, "Old", 1.0)]
    a = store.current("reports").where("file_hash = 'a'").first()
    assert (a["provider"], a["category"], a["report_date"], a["file_path"]) == ("quest", "gi", dt.date(2024, 5, 6), "/in/a.pdf")
    assert counts(store) == {"reports": 3, "extractions": 3, "panels": 3, "metrics": 5, "aliases": 0}
    head = store.current("reports").where("file_hash = 'c'").select("report_id", F.lit("function").alias("provider"), "category", "report_date", F.lit("m").alias("model"), F.lit("live").alias("extractor_kind"), F.lit(2).alias("extractor_version"), F.lit("{}").alias("raw"))
    assert store.replace("live", head, store.current("metrics").where("name = 'Iron'").withColumn("report_id", F.lit(head.first()[0])).select("report_id", "nth", *st.columns(st.ITEM)))
    assert [m[:4] for m in metrics(store) if m[0] == "c"] == [("c", 2, "Iron", None)] and counts(store)["extractions"] == 4


def test_mapping(spark, store):
    store.seed_aliases("seed", spark.createDataFrame([("zinc", "", "zinc, serum"), ("iron", "quest", "iron, quest")], st.SCHEMAS["aliases"]))
    store.ingest("one", header(spark, ("a", "Quest", "{}"), ("b", "labcorp", "{}")), rows(spark, {x: [item(" Zinc", value=1.0), item("IRON", value=2.0), item("Lead", value=3.0)] for x in "ab"}))
    now = lambda: [(m[0], m[2].strip().lower(), m[4]) for m in metrics(store)]
    assert now() == [("a", "zinc", "zinc, serum"), ("a", "iron", "iron, quest"), ("a", "lead", None), ("b", "zinc", "zinc, serum"), ("b", "iron", None), ("b", "lead", None)]
    names = "turn int, alias string, alias_provider string, canonical string"
    # A run fills what is open; the alias that is there is changed, its rows aren't; of a name twice the first fills, the last stays.
    assert store.map_names("run", spark.createDataFrame([(1, "Iron", "", "iron"), (2, "zinc", "", "zinc, new"), (3, "lead", "", "lead 1"), (4, " LEAD ", "", "lead 2"), (5, " ", "", "x")], names), only_open=True)
    assert now() == [("a", "zinc", "zinc, serum"), ("a", "iron", "iron, quest"), ("a", "lead", "lead 1"), ("b", "zinc", "zinc, serum"), ("b", "iron", "iron"), ("b", "lead", "lead 1")]
    held = lambda: sorted(tuple(r) for r in store.current("aliases").collect())
    assert held() == [("iron", "", "iron"), ("iron", "quest", "iron, quest"), ("lead", "", "lead 2"), ("zinc", "", "zinc, new")]
    # By hand, all rows of the provider change, and no other report's.
    seq = {r["file_hash"]: r["seq"] for r in store.every("reports").groupBy("file_hash").agg(F.max("seq").alias("seq")).collect()}
    assert store.map_names("hand", spark.createDataFrame([(1, "Zinc", "QUEST", "zinc, quest")], names), only_open=False)
    assert [m for m in now() if m[1] == "zinc"] == [("a", "zinc", "zinc, quest"), ("b", "zinc", "zinc, serum")] and ("zinc", "quest", "zinc, quest") in held()
    after = {r["file_hash"]: r["seq"] for r in store.every("reports").groupBy("file_hash").agg(F.max("seq").alias("seq")).collect()}
    assert after["a"] > seq["a"] and after["b"] == seq["b"]
    assert not store.map_names("hand", spark.createDataFrame([(1, "Zinc", "", "other")], names), only_open=False)
    assert counts(store) == {"reports": 2, "extractions": 2, "panels": 0, "metrics": 6, "aliases": 5}


def test_stream(spark, store, tmp_path):
    """Three files in three batches: repeated texts and unread ones are left out; a batch that runs again changes nothing."""
    from assayframe.streaming import reports as stream

    head = "Diagnostic Solutions Laboratory\nBACTERIAL PATHOGENS\nH. PYLORI\nFUNGI/YEAST\n"
    texts = [[(head + "A  1  < 2", "x"), ('{"metrics":[{"name":"b","valueNumeric":2}', "y")], [(head + "A  1  < 2", "again"), ("no report", "z"), (None, "n")], [('{"metrics":[{"name":"c","valueNumeric":3}]}', "w")]]
    registry = [p if p.name != "panel-report" else stream.parsers.panel_report(1) for p in stream.parsers.REGISTRY]
    for i, rows_ in enumerate(texts):
        spark.createDataFrame([(f"/in/{n}", "labcorp", "gi", None, t) for t, n in rows_], stream.INCOMING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "one", "two"):  # the last begins anew, as if the checkpoint had been lost
        stream.start_reports(spark, f"{tmp_path}/in", store, f"{tmp_path}/{checkpoint}", registry, 1).awaitTermination()
        got = store.current("metrics").join(store.current("reports").select("report_id", "file_path"), "report_id")
        assert sorted((r["file_path"][:4], r["name"], r["value"]) for r in got.collect()) in ([("/in/", "A", 1.0), ("/in/", "b", 2.0), ("/in/", "c", 3.0)],)
    assert store.commits().count() == 3 and counts(store)["reports"] == 3


def test_rows_meet_their_report_once(spark, store, tmp_path):
    """Rows dealt by report_id for their last batch are grouped by it where they are; the store's files are packed tightly."""
    assert store.ingest("one", header(spark, ("a", "labcorp", "{}")), rows(spark, {"a": [item("Zinc", "P", 1.0), item("Iron", "", 2.0)]}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.current("metrics").groupBy("report_id").agg(F.count("panel_id").alias("n"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(report_id") == 2 and "Exchange hashpartitioning(batch" in plan
        assert [r["n"] for r in found.collect()] == [1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = [p.name for t in ("metrics", "panels", "reports", "extractions") for p in (tmp_path / "store" / t).rglob("part-*")]
    assert files and all(".zstd." in f for f in files)
