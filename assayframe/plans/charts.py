"""Intervals over every chart's own dates, the exported file, and orders by language; SQL holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions import text as t
from assayframe.operators import overlays
from assayframe.plans import measurements as m
from assayframe.plans import views
from assayframe.plans.reading import work_folder
from assayframe.plans.views import SINCE, UNTIL
from assayframe.sources import model, sections, store


def _charts(spark, sf_dir):
    """A chart of each group and provider, over the dates of its numeric rows."""
    rows = m.fact(spark, sf_dir).where("value is not null and report_date is not null")
    return rows.groupBy("grp", "provider").agg(F.min("report_date").alias("since"), F.max("report_date").alias("until"))


def _intervals(spark, sf_dir):
    """An intervention a customer, from the first to the last order; that of every fifth is still open."""
    o = model.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("started_on"), F.to_date(F.max("o_orderdate")).alias("last"), F.min("o_orderstatus").alias("kind"))
    return o.select(F.col("o_custkey").alias("interval_id"), "kind", "started_on", F.when(F.col("o_custkey") % 5 != 0, F.date_sub("last", 400)).alias("stopped_on"))


def overlay_bands(spark, sf_dir):
    """How many interventions each chart shows, those still open, and their days in the chart."""
    pairs = overlays.overlapping_pairs(_charts(spark, sf_dir), "since", "until", _intervals(spark, sf_dir), "started_on", "stopped_on")
    left, right = F.greatest("started_on", "since"), F.least(F.coalesce("stopped_on", "until"), F.col("until"))
    return pairs.groupBy("grp", "provider").agg(F.count("*").alias("n_bands"), F.count_if(F.col("stopped_on").isNull()).alias("n_open"), F.min(left).alias("first"), F.sum(F.date_diff(right, left)).alias("days"))


def overlay_marks(spark, sf_dir):
    """Events inside each chart that belong to no intervention or to one that the chart shows."""
    events = model.table(spark, sf_dir, "events").select("event_id", F.date_sub(F.to_date("ts"), F.expr("cast(8500 + event_id % 1500 as int)")).alias("day"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("interval_id"))
    # A chart shows an event if it reaches from the earlier of the event's day and its intervention's end to the later of the day
    # and the intervention's start. Events are counted by these two dates, so neither events nor charts are carried through joins.
    events = events.where("day is not null")
    held = _intervals(spark, sf_dir).where("started_on is not null")
    single = events.where("interval_id is null").select(F.col("day").alias("left"), F.col("day").alias("right"), F.lit(True).alias("single"))
    owned = events.join(held, "interval_id").select(F.least("day", "stopped_on").alias("left"), F.greatest("day", "started_on").alias("right"), F.lit(False).alias("single"))
    marks = single.unionByName(owned).groupBy("left", "right", "single").agg(F.count("*").alias("n"))
    charts = store.written(_charts(spark, sf_dir), "charts")
    inside = overlays.dates_in_ranges(marks, "left", charts.select("since", "until").distinct(), "since", "until").where(F.col("right") <= F.col("until"))
    shown = inside.groupBy("since", "until").agg(F.sum("n").alias("n_marks"), F.sum(F.when(F.col("single"), F.col("n")).otherwise(0)).alias("n_single"))
    return charts.join(shown, ["since", "until"]).select("grp", "provider", "n_marks", "n_single")


HEAD, MORE = "canonical_name,category,raw_name,provider,date,value,value_text,units,ref_low,ref_high,flag", "intervention_name,kind,dose,started_on,stopped_on"


def export_sections(spark, sf_dir):
    """The exported file's sections: observations by metric, date and row; interventions of the window by name."""
    cats = model.canonicals(spark).select("canonical", "category")
    rows = views._exported(spark, sf_dir).join(F.broadcast(cats), "canonical")
    cells = ["canonical", t.category_label(F.col("category")), F.concat(F.trim("name"), F.lit(', "x"')), "provider", F.col("report_date").cast("string"), t.js_number(F.col("value")), "value_text", "units", t.js_number(F.col("ref_low")), t.js_number(F.col("ref_high")), "flag"]
    line = lambda cs: F.concat_ws(",", *[F.coalesce(t.csv_cell(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in cs])
    bands = overlays.overlapping(_intervals(spark, sf_dir), F.to_date(F.lit(SINCE)), F.to_date(F.lit(UNTIL)))
    name = F.concat(F.lit("Customer "), F.col("interval_id").cast("string"))
    bands = bands.select("interval_id", line([name, "kind", F.lit(None).cast("string"), F.col("started_on").cast("string"), F.col("stopped_on").cast("string")]).alias("line"))
    return [(HEAD, rows.select("canonical", "report_date", "ord", line(cells).alias("line")), ["canonical", "report_date", "ord", "line"]), (MORE, bands, ["interval_id"])]


def export_file(spark, sf_dir):
    """The exported file, written and read back: its lines and how often each occurs."""
    path = work_folder(spark, "export")
    sections.write_sections(spark, path, export_sections(spark, sf_dir))
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def names_in_order(spark, sf_dir, most=25):
    """The most frequent spellings, equal counts in the order of their language; accents and case count last."""
    name = F.col("name")
    accented = F.when(F.col("ord.l_partkey") % 2 == 0, F.translate(F.trim(name), "oi", "öí")).otherwise(F.trim(name))
    spelled = F.when(F.col("ord.l_suppkey") % 3 == 0, F.initcap(accented)).otherwise(accented)
    rows = m.fact(spark, sf_dir).select(spelled.alias("name"), F.lit(1).alias("n")).groupBy("name").agg(F.floor(F.count("*") / 1000).alias("n"))
    return rows.orderBy(F.desc("n"), t.in_order(F.col("name"))).limit(most)


CHARTS = "(select grp, provider, min(report_date) as since, max(report_date) as until from fact where value is not null and report_date is not null group by grp, provider)"
INTERVALS = "(select o_custkey as interval_id, min(o_orderstatus) as kind, cast(min(o_orderdate) as date) as started_on, case when o_custkey % 5 <> 0 then cast(max(o_orderdate) as date) - 400 end as stopped_on from orders group by o_custkey)"
PAIRS = f"{CHARTS} c join {INTERVALS} i on i.started_on <= c.until and (i.stopped_on is null or i.stopped_on >= c.since)"
NUMBER = "case when {v} is null then '' when {v} = floor({v}) then cast(cast({v} as bigint) as varchar) else cast({v} as varchar) end"
SQL = {
    "overlay_bands": f"select grp, provider, count(*) as n_bands, count(*) filter (where stopped_on is null) as n_open, min(greatest(started_on, since)) as first, cast(sum(least(coalesce(stopped_on, until), until) - greatest(started_on, since)) as bigint) as days from {PAIRS} group by grp, provider",
    "overlay_marks": f"""select grp, provider, count(*) as n_marks, count(*) filter (where e.own is null) as n_single from {CHARTS} c
  join (select cast(ts as date) - cast(8500 + event_id % 1500 as integer) as day, case when user_id % 3 <> 0 then user_id end as own from events) e on e.day between c.since and c.until left join {INTERVALS} i on i.interval_id = e.own
  where e.own is null or (i.started_on <= c.until and (i.stopped_on is null or i.stopped_on >= c.since)) group by grp, provider""",
    "export_file": f"""select line, count(*) as n from (select canonical || ',' || {views.LABEL} || ',' || chr(34) || trim(name) || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) || ',' || provider || ',' || report_date || ',' || {NUMBER.format(v='value')} || ',' || coalesce(value_text, '') || ',' || coalesce(units, '') || ',' || {NUMBER.format(v='ref_low')} || ',' || {NUMBER.format(v='ref_high')} || ',' || flag as line from {views.EXPORTED} join canonicals using (canonical)
  union all select 'Customer ' || interval_id || ',' || kind || ',,' || started_on || ',' || coalesce(cast(stopped_on as varchar), '') from {INTERVALS} where started_on <= date '{UNTIL}' and (stopped_on is null or stopped_on >= date '{SINCE}')
  union all select unnest(['{HEAD}', '', '{MORE}'])) group by line""",
    "names_in_order": """select name, n from (select name, count(*) // 1000 as n from (select case when ord[4] % 3 = 0 then array_to_string(list_transform(string_split(a, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') else a end as name
  from (select ord, case when ord[3] % 2 = 0 then translate(trim(name), 'oi', 'öí') else trim(name) end as a from fact)) group by name) order by n desc, name collate en limit 25""",
}
