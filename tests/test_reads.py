"""Observations are shuffled by their name for no query, and read once for what can be counted first."""

import pytest

import __spark_entry__
from assayframe.operators import facts
from assayframe.plans import measurements as m

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["compare_series", "distinct_lists", "provider_pivot", "points_all", "unit_excluded", "sparkline", "axis_domain"])
def test_what_is_left_reads_no_observations(spark, name):
    left = __spark_entry__.queries()[name](spark, SF).inputFiles()
    assert left and not any("lineitem" in f for f in left)


def test_names_are_broadcast_while_they_are_few(spark, monkeypatch):
    plan = lambda: m.fact(spark, SF).select("canonical")._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    few = plan()
    monkeypatch.setattr(facts, "BROADCAST_BYTES", 10)
    assert plan() == few - 1


@pytest.mark.parametrize("name", ["export_series", "export_observations", "export_csv_lines"])
def test_the_export_and_its_vote_read_observations_once(spark, name):
    left = __spark_entry__.queries()[name](spark, SF).inputFiles()
    assert left and not any("lineitem" in f for f in left)


def below(plan: str, node: str) -> str:
    """The part of a plan's text that is below a node."""
    lines = plan.splitlines()
    depth = [next((i for i, c in enumerate(line) if c.isalpha()), 0) for line in lines]
    at = next(i for i, line in enumerate(lines) if node in line)
    end = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    return "\n".join(lines[at:end])


@pytest.mark.parametrize("rows", [m.fact, m.mapped])
def test_observations_meet_reports_before_they_are_described(spark, rows):
    plan = below(rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString(), "Join Inner, (report_id")
    assert "lineitem" in plan or "l_partkey" in plan
    assert not any(c in plan for c in ("targets", "AS name", "AS ord", "AS units"))


def test_names_too_many_to_broadcast_give_the_same_rows(spark, monkeypatch):
    rows = lambda: sorted(map(str, m.mapped(spark, SF).select("ord", "canonical", "key", "provider").collect()))
    few = rows()
    monkeypatch.setattr(facts, "BROADCAST_BYTES", 10)
    assert few and rows() == few


def test_marks_are_counted_by_their_dates_before_they_meet_charts(spark):
    plan = __spark_entry__.queries()["overlay_marks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [left" in below(plan, "Join Inner, ((((left")


def test_printed_lines_read_their_reports_once_for_the_headings(spark):
    plan = __spark_entry__.queries()["section_carry"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4  # lines and parts, for headings and for rows
    assert "line" not in plan.split("Window [")[1].splitlines()[1]


def test_the_fold_deals_large_tables_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from assayframe.sources import model

    query = __spark_entry__.queries()["within_report_dedupe"]
    plain = query(spark, SF)
    monkeypatch.setattr(model, "TASK_LINES", 50)
    many = query(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan(many) and "RepartitionByExpression" not in plan(plain)
    assert sorted(map(str, many.collect())) == sorted(map(str, plain.collect()))


def test_the_pivot_folds_its_observations_without_sorting_them(spark, monkeypatch):
    from assayframe.sources import store

    seen, write = [], store.written
    monkeypatch.setattr(store, "written", lambda rows, *a: seen.append(rows) or write(rows, *a))
    query = lambda: sorted(map(str, __spark_entry__.queries()["provider_pivot"](spark, SF).collect()))
    few = query()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert any("lineitem" in f for f in seen[0].inputFiles()) and "HashAggregate(keys=[canonical" in plan and "SortAggregate(key=[canonical" not in plan
    monkeypatch.setattr(facts, "BROADCAST_BYTES", 10)
    assert few and query() == few


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_the_last_report_is_named_by_time_and_id(spark, kind):
    from datetime import datetime as t

    ids = [-(2**63), -1, 0, 7, 2**63 - 1]
    times = [t(1, 1, 1), t(1969, 12, 31, 23, 59, 59, 999999), t(2024, 3, 31, 1, 30), t(2024, 3, 31, 2, 30), t(2024, 10, 27, 2, 30, 0, 1), t(9999, 12, 31, 23, 59, 59, 999999)]
    rows = [(g, times[g % 6], ids[k]) for g in range(6) for k in range(5)] + [(6 + g, times[g + d], ids[2 - d]) for g in range(5) for d in (0, 1)]
    df = spark.createDataFrame(rows, "g int, uploaded_at timestamp_ntz, report_id long").selectExpr("g", f"cast(uploaded_at as {kind}) as uploaded_at", "report_id")
    got = {r["g"]: r["id"] for r in df.groupBy("g").agg(facts.last_report()).select("g", facts.last_report_id().alias("id")).collect()}
    assert got == {g: max((u, i) for h, u, i in rows if h == g)[1] for g in range(11)}
