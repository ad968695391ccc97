"""Overlays, chart geometry, extraction replay and diff, and text tokens over the measurement model; SQL as for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions import tokens
from assayframe.operators import facts, overlays
from assayframe.operators.diff import extract_diff as diff
from assayframe.plans import measurements as m
from assayframe.sources import model, store

SINCE, UNTIL = "2024-01-10", "2024-01-20"


def _bands(spark, sf_dir):
    return overlays.overlapping(m.interventions(spark, sf_dir), F.to_date(F.lit(SINCE)), F.to_date(F.lit(UNTIL)))


def interval_overlap(spark, sf_dir):
    """Interventions that meet the window."""
    return _bands(spark, sf_dir)


def export_interventions(spark, sf_dir):
    """The same with open ends closed at the window's end."""
    return _bands(spark, sf_dir).select("user_id", "started_on", F.coalesce("stopped_on", F.to_date(F.lit(UNTIL))).alias("ended_on"))


def marker_semi(spark, sf_dir):
    """Events of the window that belong to no intervention or to a shown one."""
    day = F.to_date("ts")
    marks = model.table(spark, sf_dir, "events").where(day.between(F.to_date(F.lit(SINCE)), F.to_date(F.lit(UNTIL))))
    marks = marks.select("event_id", day.alias("day"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("interval_id"))
    return overlays.shown_markers(marks, _bands(spark, sf_dir))


def overlay_geometry(spark, sf_dir):
    """Each band cut to the window."""
    return _bands(spark, sf_dir).select("user_id", F.greatest("started_on", F.to_date(F.lit(SINCE))).alias("left_on"), F.least(F.coalesce("stopped_on", F.to_date(F.lit(UNTIL))), F.to_date(F.lit(UNTIL))).alias("right_on"))


def _ends(points):
    return points.groupBy("canonical").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def axis_domain(spark, sf_dir):
    lo, hi = overlays.padded(F.col("lo"), F.col("hi"))
    return _ends(m.metric_series_points(spark, sf_dir)).select("canonical", F.round(lo, 6).alias("y_lo"), F.round(hi, 6).alias("y_hi"))


def pdf_domain(spark, sf_dir):
    lo, hi = overlays.padded_from_zero(F.col("lo"), F.col("hi"))
    return _ends(m.metric_series_points(spark, sf_dir)).select("canonical", F.round(lo, 6).alias("y_lo"), F.round(hi, 6).alias("y_hi"))


def sparkline(spark, sf_dir):
    """Height of each point; the ends are an aggregate that joins back, so no series is in one task."""
    points = m.metric_series_points(spark, sf_dir)
    points = points.join(_ends(points), "canonical")
    return points.select("canonical", "report_date", F.round(overlays.scaled(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("y"))


def provider_pivot(spark, sf_dir):
    """A metric's points by date and provider, in long form so that any number of providers fits; the last one written counts."""
    by = "canonical", "unit_key", "report_date", "provider"
    # Only numbers are folded over all rows, which Spark does by hash, where rows would be sorted by group and spilled. They name
    # the last report of each group and the first of each unit; the rows of these few reports then say all else.
    dealt = lambda rows: model.dealt(rows, model.table(spark, sf_dir, "lineitem"), "report_id")
    counts = m.plottable(spark, sf_dir, dealt=dealt).groupBy(*by).agg(facts.last_report(), F.min("report_id").alias("first"), F.count("*").alias("n"))
    counts = store.written(counts, "pivot-counts")
    firsts = counts.groupBy("canonical", "unit_key").agg(F.min(F.struct("report_date", "first"))["first"].alias("report_id"))
    reports = counts.select(facts.last_report_id().alias("report_id")).union(firsts.select("report_id")).distinct()
    few = F.broadcast(reports) if reports.count() * 32 <= facts.BROADCAST_BYTES else reports
    told = m.plottable(spark, sf_dir, of=few).groupBy(*by).agg(F.max(F.struct("uploaded_at", "ord", "value")).alias("k"), F.min(F.struct("report_date", "ord")).alias("seen"))
    told = told.withColumn("n", F.lit(0).cast("long"))
    rows = counts.select(*by, "n").unionByName(told, allowMissingColumns=True).groupBy(*by).agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.min("seen").alias("seen"))
    cells = facts.partition_cells(store.written(rows, "pivot"), model.factors(spark)).where(~F.col("excluded"))
    value = F.col("k.value") * F.coalesce("factor", F.lit(1.0))
    return cells.groupBy("canonical", "report_date", "provider").agg(F.max(F.struct("k.uploaded_at", "k.ord", value.alias("value")))["value"].alias("value"))


def _extracted(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in model.UNITS], F.lit(None)), (F.col("ord.l_suppkey") % 6 + 1).cast("int"))
    return m.fact(spark, sf_dir).select("report_id", F.coalesce("canonical", F.lit("")).alias("panel"), F.col("key").alias("name"), "value", "value_text", unit.alias("unit"), "ord")


def extract_diff(spark, sf_dir):
    """Rows of each bucket per report, between the extraction and one with lost rows, shifted values and lost panels."""
    left = _extracted(spark, sf_dir)
    supplier, part = F.col("ord.l_suppkey"), F.col("ord.l_partkey")
    right = left.where(supplier % 11 != 0).withColumn("value", F.when(part % 7 == 0, F.col("value") * 1.2).when(part % 7 == 1, F.col("value") * 1.04).otherwise(F.col("value")))
    text = F.when(part % 17 == 0, F.lit("5 (high)")).when(part % 3 == 0, F.upper("value_text")).otherwise(F.col("value_text"))
    right = right.withColumn("value_text", text).withColumn("panel", F.when(part % 5 != 0, F.col("panel"))).withColumn("unit", F.when(part % 13 == 0, "mg/dL").otherwise(F.col("unit")))
    return diff(left, right).groupBy("report_id").agg(*[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("matched", "value", "units", "left", "right")])


def latest_extraction(spark, sf_dir):
    """The last payload of each user, as the newest extraction of a report."""
    rows = model.table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


def replay_metrics(spark, sf_dir):
    """Metrics read again from stored JSON; a payload that can't be read gives none."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return latest_extraction(spark, sf_dir).select("user_id", k.alias("k")).where("k is not null")


def prose_lines(spark, sf_dir):
    """Lines of running prose of each document."""
    lines = model.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(tokens.is_prose(F.col("line"))).alias("n_prose"), F.count("*").alias("n_lines"))


def parsed_lines(spark, sf_dir):
    """Printed result lines, read again: the columns that they were printed from."""
    num = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    printed = F.concat(
        F.trim("name"), F.lit("  "), F.coalesce(num("value"), F.lit("<dl")), F.when(F.col("flag") == "high", "  H").when(F.col("flag") == "low", "  Low ↓").otherwise(""),
    )
    ref = F.concat(num("ref_low"), F.lit(" - "), num("ref_high"), F.lit("org/g "), num("ref_low"), F.lit(" - "), num("ref_high"))
    rows = model.metrics(spark, sf_dir).select("ord", printed.alias("line"), ref.alias("ref"))
    part = tokens.line_tokens(F.col("line"))
    read = rows.select("ord", part[0].alias("name"), tokens.value_token(F.array_join(F.slice(part, 2, 9), " ")).alias("v"), tokens.range_token(F.col("ref")).alias("r"))
    return read.groupBy("name", "v.flag", "v.text", "r.units").agg(F.count("*").alias("n"), F.sum(F.col("v.numeric").cast("decimal(12,2)")).cast("double").alias("total"),
                                                                    F.sum(F.col("r.low").cast("decimal(12,2)")).cast("double").alias("low"), F.sum(F.col("r.high").cast("decimal(12,2)")).cast("double").alias("high"))


BANDS = f"select user_id, started_on, stopped_on from iv where started_on <= date '{UNTIL}' and (stopped_on is null or stopped_on >= date '{SINCE}')"
SQL = {
    "interval_overlap": BANDS,
    "export_interventions": f"select user_id, started_on, coalesce(stopped_on, date '{UNTIL}') as ended_on from ({BANDS})",
    "marker_semi": f"select event_id, day, interval_id from (select event_id, cast(ts as date) as day, case when user_id % 3 <> 0 then user_id end as interval_id from events) where day between date '{SINCE}' and date '{UNTIL}' and (interval_id is null or interval_id in (select user_id from ({BANDS})))",
    "overlay_geometry": f"select user_id, greatest(started_on, date '{SINCE}') as left_on, least(coalesce(stopped_on, date '{UNTIL}'), date '{UNTIL}') as right_on from ({BANDS})",
    "axis_domain": "select canonical, round(lo - 0.15 * s, 6) as y_lo, round(hi + 0.15 * s, 6) as y_hi from (select canonical, min(value) as lo, max(value) as hi, greatest(max(value) - min(value), abs(max(value)) * 0.1, 1) as s from pts group by canonical)",
    "pdf_domain": "select canonical, round(case when lo >= 0 then greatest(0, lo - 0.1 * s) else lo - 0.1 * s end, 6) as y_lo, round(hi + 0.1 * s, 6) as y_hi from (select canonical, min(value) as lo, max(value) as hi, case when min(value) = max(value) then greatest(abs(max(value)) * 0.1, 1) else max(value) - min(value) end as s from pts group by canonical)",
    "sparkline": "select canonical, report_date, round(22 - (value - lo) / greatest(1e-9, hi - lo) * 20, 6) as y from pts join (select canonical, min(value) as lo, max(value) as hi from pts group by canonical) using (canonical)",
    "provider_pivot": "select canonical, report_date, provider, arg_max(rescaled, {'u': uploaded_at, 'o': ord, 'r': rescaled}) as value from conv group by canonical, report_date, provider",
    "extract_diff": """select report_id, count(*) filter (where b = 'matched') as n_matched, count(*) filter (where b = 'value') as n_value, count(*) filter (where b = 'units') as n_units, count(*) filter (where b = 'left') as n_left, count(*) filter (where b = 'right') as n_right
      from (select report_id, case when y_ord is null then 'left' when x_ord is null then 'right' when x_unit <> y_unit then 'units' when not (case when x_text is not null or y_text is not null then coalesce(lower(x_text) = lower(y_text), false) when x_value is not null and y_value is not null then x_value = y_value or abs(x_value - y_value) <= 0.05 * greatest(abs(x_value), abs(y_value)) else x_value is null and y_value is null end) then 'value' else 'matched' end as b
        from (select report_id, x_ord, y_ord, x_unit, y_unit, x_value, y_value, x_text, y_text from p1 where x_ord is not null and y_ord is not null union all select report_id, x_ord, y_ord, x_unit, y_unit, x_value, y_value, x_text, y_text from p2)) group by report_id""",
    "latest_extraction": "select user_id, x.e as event_id, x.p as props from (select user_id, arg_max({'e': event_id, 'p': props}, {'t': ts, 'e': event_id}) as x from events group by user_id)",
    "replay_metrics": "select user_id, k from (select user_id, cast(json_extract(arg_max(props, {'t': ts, 'e': event_id}), '$.k') as bigint) as k from events group by user_id) where k is not null",
    "prose_lines": r"select doc_id, count(*) filter (where len(regexp_extract_all(line, '\b[a-z]{3,}\b')) >= 5) as n_prose, count(*) as n_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null) group by doc_id",
    "parsed_lines": "select trim(name) as name, case when flag <> 'ok' then flag end as flag, value_text as text, 'org/g' as units, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total, cast(sum(cast(ref_low as decimal(12,2))) as double) as low, cast(sum(cast(ref_high as decimal(12,2))) as double) as high from metrics group by 1, 2, 3",
}
#: The two passes of the diff: sides first by key, then what is left by name and turn.
DIFF = """, l0 as (select report_id, coalesce(canonical, '') as panel, key as name, value, value_text as text, ord, coalesce(lower(units), '') as unit from fact),
r0 as (select report_id, case when ord[3] % 5 <> 0 then panel else '' end as panel, name, case ord[3] % 7 when 0 then value * 1.2 when 1 then value * 1.04 else value end as value, case when ord[3] % 17 = 0 then '5 (high)' when ord[3] % 3 = 0 then upper(text) else text end as text, ord, case when ord[3] % 13 = 0 then 'mg/dl' else unit end as unit from l0 where ord[4] % 11 <> 0),
l1 as (select * from (select *, case when panel <> '' then panel || '::' || name else name end as k, row_number() over (partition by report_id, panel, name order by ord) as r from l0) where r = 1),
r1 as (select * from (select *, case when panel <> '' then panel || '::' || name else name end as k, row_number() over (partition by report_id, panel, name order by ord) as r from r0) where r = 1),
p1 as (select coalesce(x.report_id, y.report_id) as report_id, coalesce(x.name, y.name) as name, x.ord as x_ord, y.ord as y_ord, x.unit as x_unit, y.unit as y_unit, x.value as x_value, y.value as y_value, x.text as x_text, y.text as y_text from l1 x full join r1 y on x.report_id = y.report_id and x.k = y.k),
lx as (select *, row_number() over (partition by report_id, name order by x_ord desc) as t from p1 where y_ord is null),
ry as (select *, row_number() over (partition by report_id, name order by y_ord) as t from p1 where x_ord is null),
p2 as (select coalesce(x.report_id, y.report_id) as report_id, x.x_ord, y.y_ord, x.x_unit, y.y_unit, x.x_value, y.y_value, x.x_text, y.y_text from lx x full join ry y on x.report_id = y.report_id and x.name = y.name and x.t = 1 and y.t = 1)
"""
