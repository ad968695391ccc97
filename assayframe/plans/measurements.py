"""Analytics over the enriched fact. Each function takes (spark, sf_dir); SQL holds the same queries for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.text import canonical_unit, in_order, js_number, normalize_name, provider_display, trimmed
from assayframe.operators import facts
from assayframe.sources import model, store


def _enriched(spark, sf_dir, *of_part, of=None, **asked):
    """of: the reports (report_id) whose rows are asked for, if not all."""
    lines, reports, aliases = model.lines(spark, sf_dir, *of_part), model.reports(spark, sf_dir), model.aliases(spark, sf_dir)
    if of is not None:
        lines, reports = (rows.join(of, "report_id", "left_semi") for rows in (lines, reports))
    return facts.enrich(lines, reports, aliases, described=model.described, name=model.line_name(), **asked)


def fact(spark, sf_dir, *of_part):
    return _enriched(spark, sf_dir, *of_part)


def mapped(spark, sf_dir, among=(), **asked):
    """Rows with a canonical metric, or with one of those named."""
    return _enriched(spark, sf_dir, known=True, among=among, **asked)


def with_category(spark, sf_dir):
    return mapped(spark, sf_dir).join(F.broadcast(model.canonicals(spark)), "canonical")


def dash_latest(spark, sf_dir):
    """Latest observation of each group, numeric or not."""
    top = F.max_by(F.struct("value", "value_text", "flag", "units", "report_date"), F.struct("report_date", "ord")).alias("x")
    return fact(spark, sf_dir).groupBy("grp").agg(top).select("grp", "x.*")


def dash_groups(spark, sf_dir):
    """Rows, reports and label (the first row's name) of each group."""
    return fact(spark, sf_dir).groupBy("grp").agg(
        F.count("*").alias("n_rows"), F.count_distinct("report_id").alias("n_reports"), trimmed(F.min_by("name", "ord")).alias("label")
    )


def dash_trend(spark, sf_dir):
    """Last numeric value against the mean of those before it, from sums, so no group's history is collected."""
    rows = fact(spark, sf_dir).where("value is not null").groupBy("grp").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,12)")).alias("total"), F.max_by("value", F.struct("report_date", "ord")).alias("last")
    )
    prior = (F.col("total").cast("double") - F.col("last")) / F.nullif(F.col("n") - 1, F.lit(0))
    change = (F.col("last") - prior) / F.abs(prior)
    label = F.when((F.col("n") < 2) | (F.abs(prior) < 1e-9), "flat").when(change > 0.05, "up").when(change < -0.05, "down").otherwise("flat")
    return rows.select("grp", F.col("n").alias("n_points"), "last", label.alias("trend"))


def category_counts(spark, sf_dir):
    return with_category(spark, sf_dir).groupBy("category").agg(F.count_distinct("canonical").alias("n"))


def tag_counts(spark, sf_dir):
    return with_category(spark, sf_dir).select("canonical", "tags").distinct().select("canonical", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def unmapped_counts(spark, sf_dir):
    none = F.col("canonical").isNull()
    return fact(spark, sf_dir).agg(F.count_if(none).alias("n_rows"), F.count_distinct(F.when(none & (F.col("key") != ""), F.col("key"))).alias("n_names"))


def unmapped_queue(spark, sf_dir):
    """Names without a metric, most frequent first: rows, providers, and the first row of the newest report as a sample."""
    rows = fact(spark, sf_dir).where(F.col("canonical").isNull() & (F.col("key") != ""))
    shown = F.coalesce(js_number(F.col("value")), "value_text", F.lit("—")).alias("shown")
    first = F.struct("report_date", "uploaded_at", F.struct(*[(-F.col(f"ord.{c}")).alias(c) for c in model.ORD]), F.col("value"))
    sample = F.max_by(F.struct("report_date", "report_id", "units", shown, trimmed(F.col("name")).alias("name")), first).alias("s")
    out = rows.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), sample)
    return out.orderBy(F.desc("n"), in_order(F.col("key"))).select(
        "key", "n", "providers", F.col("s.name").alias("sample_name"), F.col("s.report_id").alias("sample_report"), F.col("s.report_date").alias("sample_date"),
        F.col("s.shown").alias("sample_value"), F.col("s.units").alias("sample_units"))


def report_rollup(spark, sf_dir):
    """Per report with metrics: rows, flagged rows, categories, and whether any row is unmapped."""
    cats = model.canonicals(spark).select("canonical", "category")
    return fact(spark, sf_dir).join(F.broadcast(cats), "canonical", "left").groupBy("report_id", "provider", "report_date").agg(
        F.count("*").alias("n_rows"), F.count_if(facts.is_flagged(F.col("flag"))).alias("n_flagged"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.bool_or(F.col("canonical").isNull()).alias("any_unmapped"))


def report_category_counts(spark, sf_dir):
    return with_category(spark, sf_dir).groupBy("category").agg(F.count_distinct("report_id").alias("n_reports"))


def report_tag_counts(spark, sf_dir):
    return with_category(spark, sf_dir).select("report_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_distinct("report_id").alias("n_reports"))


def dominant_value(spark, sf_dir):
    """Dominant unit key of each metric's numeric rows; null counts."""
    rows = mapped(spark, sf_dir).where("value is not null")
    return facts.dominant(rows, ["canonical"], "unit_key", F.struct("report_date", "ord")).withColumnRenamed("dominant", "unit_key")


def unit_dominant_filter(spark, sf_dir):
    """Rows that the dominant unit keeps and leaves out, per metric."""
    rows = mapped(spark, sf_dir).where("value is not null")
    top = facts.dominant(rows, ["canonical"], "unit_key", F.struct("report_date", "ord"))
    same = F.col("unit_key").eqNullSafe(F.col("dominant"))
    return rows.join(top, "canonical").groupBy("canonical").agg(F.count_if(same).alias("n_kept"), F.count_if(~same).alias("n_excluded"))


def units_mismatch(spark, sf_dir):
    return mapped(spark, sf_dir).where("value is not null").groupBy("canonical").agg((F.count_distinct("unit_key") > 1).alias("mismatch"))


def distinct_lists(spark, sf_dir):
    """Names and units of each metric in order, and its providers as they were first seen."""
    # Spellings, units and providers that occur together come first, so the rows are read once for all lists.
    name = trimmed(F.lower("name")).alias("name")
    rows = store.written(mapped(spark, sf_dir).groupBy("canonical", "provider", name, "units").agg(F.min(F.struct("report_date", "ord")).alias("first")), "lists")
    pick = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c + "s" if c == "name" else c)
    seen = rows.groupBy("canonical", "provider").agg(F.min("first").alias("first"))
    providers = seen.groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct("first", "provider"))).alias("ps"))  # a row a provider
    lists = rows.groupBy("canonical").agg(pick("name"), pick("units"))
    return lists.join(providers, "canonical").select("canonical", "names", "units", F.array_join(F.transform("ps", lambda p: p["provider"]), "|").alias("providers"))


def plottable(spark, sf_dir, among=(), **asked):
    return mapped(spark, sf_dir, among, **asked).where("value is not null and report_date is not null")


def converted(spark, sf_dir):
    return facts.partition_units(plottable(spark, sf_dir), model.factors(spark), F.struct("report_date", "ord"))


def unit_convert(spark, sf_dir):
    return converted(spark, sf_dir).where("factor is not null and factor <> 1").select(
        "canonical", "report_id", F.col("ord.l_linenumber").alias("line"), F.col("ord.l_partkey").alias("part"), "value", "ref_low", "ref_high", "rescaled", "low", "high")


def unit_excluded(spark, sf_dir):
    n = lambda own: F.sum(F.when(own, F.col("n")).otherwise(0))
    return cells(spark, sf_dir).groupBy("canonical").agg(n(F.col("excluded")).alias("n_excluded"), n(~F.col("excluded")).alias("n_kept"))


def cells(spark, sf_dir):
    """Metrics, units and dates with what series need of their rows. Votes and points both read them, so they are written: a
    table of dates by metrics, which the rows are read once for."""
    found = facts.unit_cells(plottable(spark, sf_dir), F.struct("report_date", "ord"))
    return facts.partition_cells(store.written(found, "cells"), model.factors(spark))


def series_points(spark, sf_dir):
    return facts.cell_points(cells(spark, sf_dir).where(~F.col("excluded")))


def metric_series_points(spark, sf_dir):
    """One point per metric and date, in one unit a metric; the newest upload wins."""
    return series_points(spark, sf_dir).select("canonical", "report_date", "value", "low", "high", "units", "provider", "others", "conflict")


def series_stats(spark, sf_dir):
    return metric_series_points(spark, sf_dir).groupBy("canonical").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"),
        F.max_by("value", "report_date").alias("latest"), F.count_if("conflict").alias("n_conflicts"),
        F.sum(F.when(~F.col("conflict"), F.col("others")).otherwise(0)).alias("n_collapsed"))


def export_candidates(spark, sf_dir, since="1996-01-01", until="1998-12-31"):
    inside = F.col("report_date").between(F.to_date(F.lit(since)), F.to_date(F.lit(until)))
    return mapped(spark, sf_dir).groupBy("canonical").agg(F.count_if(inside).alias("n_window"), F.count_if(inside & facts.is_flagged(F.col("flag"))).alias("n_flagged"))


def non_numeric_count(spark, sf_dir):
    return mapped(spark, sf_dir).groupBy("canonical").agg(F.count_if(F.col("value").isNull()).alias("n_text"))


def compare_domain(spark, sf_dir):
    rows = mapped(spark, sf_dir).where("value is not null")
    return rows.agg(F.min("report_date").alias("lo"), F.max("report_date").alias("hi"), F.greatest(F.lit(1), F.year(F.max("report_date")) - F.year(F.min("report_date")) + 1).cast("long").alias("years"))


def recent_reports(spark, sf_dir, n=5):
    return model.reports(spark, sf_dir).orderBy(F.desc_nulls_last("report_date"), F.desc("uploaded_at"), "report_id").limit(n).select("report_id", "provider", "report_date")


def report_type_breakdown(spark, sf_dir):
    return model.reports(spark, sf_dir).groupBy("report_category").agg(F.count("*").alias("n"))


def search_metrics(spark, sf_dir, text="in", n=8):
    """Metrics by name or alias; a name hit ranks first."""
    like = f"%{text.strip().lower()}%"
    alias = model.aliases(spark, sf_dir).groupBy("canonical").agg(F.count("*").alias("n_aliases"), F.min(F.when(F.col("alias").like(like), F.col("alias"))).alias("matched_alias"))
    found = model.canonicals(spark).join(alias, "canonical", "left").withColumn("by_name", F.col("canonical").like(like))
    return found.where(F.col("by_name") | F.col("matched_alias").isNotNull()).orderBy(F.desc("by_name"), in_order(F.col("canonical"))).limit(n).select("canonical", "by_name", "matched_alias", "n_aliases")


def file_hash_dedupe(spark, sf_dir):
    """The first document of each content hash."""
    docs = model.table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def interventions(spark, sf_dir):
    rows = model.table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("started_on"), F.to_date(F.max("ts")).alias("last_on"))
    return rows.select("user_id", "started_on", F.when(F.col("user_id") % 5 != 0, F.col("last_on")).alias("stopped_on"))


def interventions_split(spark, sf_dir):
    return interventions(spark, sf_dir).groupBy(F.col("stopped_on").isNull().alias("active")).agg(F.count("*").alias("n"), F.min("started_on").alias("earliest"))


def intervention_days(spark, sf_dir, anchor="2024-02-01"):
    days = F.greatest(F.lit(0), F.date_diff(F.coalesce("stopped_on", F.to_date(F.lit(anchor))), F.col("started_on")))
    return interventions(spark, sf_dir).select("user_id", days.cast("long").alias("days"))


def provider_names(spark, sf_dir):
    return model.reports(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("n")).select("provider", provider_display(F.col("provider")).alias("display"), "n")


def canonical_units(spark, sf_dir):
    return model.metrics(spark, sf_dir).groupBy("units").agg(F.count("*").alias("n")).select("units", canonical_unit(F.col("units")).alias("unit_key"), "n")


def manual_map_backfill(spark, sf_dir, name="cold ring", target="ring"):
    """Rows per metric after a name is mapped by hand; it overwrites what was mapped before."""
    new = F.when(F.col("key") == normalize_name(F.lit(name)), F.lit(target)).otherwise(F.col("canonical"))
    return fact(spark, sf_dir).groupBy(new.alias("canonical")).agg(F.count("*").alias("n"))


SQL = {
    "dash_latest": "select grp, x.value, x.value_text, x.flag, x.units, x.report_date from (select grp, arg_max_null({'value': value, 'value_text': value_text, 'flag': flag, 'units': units, 'report_date': report_date}, {'d': report_date, 'o': ord}) as x from fact group by grp)",
    "dash_groups": "select grp, count(*) as n_rows, count(distinct report_id) as n_reports, trim(arg_min(name, ord)) as label from fact group by grp",
    "dash_trend": "select grp, n as n_points, last, case when n < 2 or abs(p) < 1e-9 then 'flat' when (last - p) / abs(p) > 0.05 then 'up' when (last - p) / abs(p) < -0.05 then 'down' else 'flat' end as trend from (select *, (total - last) / nullif(n - 1, 0) as p from (select grp, count(*) as n, cast(sum(cast(value as decimal(38,12))) as double) as total, arg_max(value, {'d': report_date, 'o': ord}) as last from fact where value is not null group by grp))",
    "category_counts": "select category, count(distinct canonical) as n from fact join canonicals using (canonical) group by category",
    "tag_counts": "select tag, count(*) as n from (select distinct canonical, unnest(tags) as tag from fact join canonicals using (canonical)) group by tag",
    "unmapped_counts": "select count(*) filter (where canonical is null) as n_rows, count(distinct key) filter (where canonical is null and key <> '') as n_names from fact",
    "unmapped_queue": "select q.key, q.n, q.providers, trim(s.name) as sample_name, s.report_id as sample_report, s.report_date as sample_date, coalesce(case when s.value = floor(s.value) then cast(cast(s.value as bigint) as varchar) else cast(s.value as varchar) end, s.value_text, '—') as sample_value, s.units as sample_units from (select key, count(*) as n, string_agg(distinct provider, ',' order by provider) as providers from fact where canonical is null and key <> '' group by key) q join (select *, row_number() over (partition by key order by report_date desc nulls last, uploaded_at desc, ord, value desc nulls last) as r from fact where canonical is null) s on q.key = s.key and s.r = 1",
    "report_rollup": "select report_id, provider, report_date, count(*) as n_rows, count(*) filter (where flag in ('high', 'low')) as n_flagged, coalesce(string_agg(distinct category, ',' order by category), '') as categories, bool_or(canonical is null) as any_unmapped from fact left join canonicals using (canonical) group by all",
    "report_category_counts": "select category, count(distinct report_id) as n_reports from fact join canonicals using (canonical) group by category",
    "report_tag_counts": "select tag, count(distinct report_id) as n_reports from (select report_id, unnest(tags) as tag from fact join canonicals using (canonical)) group by tag",
    "dominant_value": "select canonical, unit_key from (select canonical, unit_key, row_number() over (partition by canonical order by n desc, seen) as r from (select canonical, unit_key, count(*) as n, min({'d': report_date, 'o': ord}) as seen from fact where canonical is not null and value is not null group by canonical, unit_key)) where r = 1",
    "unit_dominant_filter": "select f.canonical, count(*) filter (where f.unit_key is not distinct from d.unit_key) as n_kept, count(*) filter (where f.unit_key is distinct from d.unit_key) as n_excluded from fact f join (select canonical, unit_key from (select canonical, unit_key, row_number() over (partition by canonical order by n desc, seen) as r from (select canonical, unit_key, count(*) as n, min({'d': report_date, 'o': ord}) as seen from fact where canonical is not null and value is not null group by canonical, unit_key)) where r = 1) d on f.canonical = d.canonical where f.value is not null group by f.canonical",
    "units_mismatch": "select canonical, count(distinct unit_key) > 1 as mismatch from fact where canonical is not null and value is not null group by canonical",
    "distinct_lists": "select canonical, names, units, providers from (select canonical, string_agg(distinct key, '|' order by key) as names, string_agg(distinct units, '|' order by units) as units from fact where canonical is not null group by canonical) join (select canonical, string_agg(provider, '|' order by seen) as providers from (select canonical, provider, min({'d': report_date, 'o': ord}) as seen from fact where canonical is not null group by canonical, provider) group by canonical) using (canonical)",
    "unit_convert": "select canonical, report_id, ord[2] as line, ord[3] as part, value, ref_low, ref_high, rescaled, low, high from parted where factor is not null and factor <> 1",
    "unit_excluded": "select canonical, count(*) filter (where excluded) as n_excluded, count(*) filter (where not excluded) as n_kept from parted group by canonical",
    "metric_series_points": "select canonical, report_date, value, low, high, units, provider, others, conflict from pts",
    "series_stats": "select canonical, count(*) as n, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean, arg_max(value, report_date) as latest, count(*) filter (where conflict) as n_conflicts, cast(sum(case when conflict then 0 else others end) as bigint) as n_collapsed from pts group by canonical",
    "export_candidates": "select canonical, count(*) filter (where w) as n_window, count(*) filter (where w and flag in ('high', 'low')) as n_flagged from (select *, report_date between date '1996-01-01' and date '1998-12-31' as w from fact where canonical is not null) group by canonical",
    "non_numeric_count": "select canonical, count(*) filter (where value is null) as n_text from fact where canonical is not null group by canonical",
    "compare_domain": "select min(report_date) as lo, max(report_date) as hi, cast(greatest(1, year(max(report_date)) - year(min(report_date)) + 1) as bigint) as years from fact where canonical is not null and value is not null",
    "recent_reports": "select report_id, provider, report_date from reports order by report_date desc nulls last, uploaded_at desc, report_id limit 5",
    "report_type_breakdown": "select report_category, count(*) as n from reports group by report_category",
    "search_metrics": "select canonical, by_name, matched_alias, n_aliases from (select c.canonical, c.canonical like '%in%' as by_name, a.matched_alias, a.n_aliases from canonicals c left join (select canonical, count(*) as n_aliases, min(alias) filter (where alias like '%in%') as matched_alias from aliases group by canonical) a using (canonical)) where by_name or matched_alias is not null order by by_name desc, canonical limit 8",
    "file_hash_dedupe": "select sha256(text) as file_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "interventions_split": "select stopped_on is null as active, count(*) as n, min(started_on) as earliest from iv group by 1",
    "intervention_days": "select user_id, cast(greatest(0, date_diff('day', started_on, coalesce(stopped_on, date '2024-02-01'))) as bigint) as days from iv",
    "provider_names": "select provider, array_to_string(list_transform(list_filter(regexp_split_to_array(provider, '[-_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') as display, count(*) as n from reports group by provider",
    "canonical_units": "select units, case lower(replace(units, 'µ', 'u')) when 'x10e3/ul' then 'k/ul' when 'thousand/ul' then 'k/ul' else lower(replace(units, 'µ', 'u')) end as unit_key, count(*) as n from metrics group by units",
    "manual_map_backfill": "select case when key = 'cold ring' then 'ring' else canonical end as canonical, count(*) as n from fact group by 1",
}
#: By the rules of the series: a metric with a factor table keeps the units it lists, values and references rescaled; another
#: with more than one unit keeps the unit that most of its dated numeric rows have (null counts, ties to the one seen first).
EXTRA = """, num as (select * from fact where canonical is not null and value is not null and report_date is not null),
votes as (select canonical, unit_key, count(*) as n, min({'d': report_date, 'o': ord}) as seen from num group by canonical, unit_key),
top as (select canonical, unit_key as top_unit from (select *, row_number() over (partition by canonical order by n desc, seen) as r from votes) where r = 1),
kinds as (select canonical, count(unit_key) as n_units from votes group by canonical),
parted as (select n.*, f.factor, f.display_unit, n.value * coalesce(f.factor, 1) as rescaled, n.ref_low * coalesce(f.factor, 1) as low, n.ref_high * coalesce(f.factor, 1) as high,
  case when n.canonical in (select canonical from factors) then f.factor is null when k.n_units > 1 then n.unit_key is distinct from t.top_unit else false end as excluded
  from num n left join factors f on n.canonical = f.canonical and n.unit_key = f.unit_key join top t on n.canonical = t.canonical join kinds k on n.canonical = k.canonical),
conv as (select * from parted where not excluded),
pts as (select canonical, report_date, rescaled as value, low, high, units, provider, report_id, ord, display_unit, n - 1 as others, lo < hi as conflict from (select *, row_number() over (partition by canonical, report_date order by uploaded_at desc, ord, rescaled, low, high) as r,
  count(*) over (partition by canonical, report_date) as n, min(rescaled) over (partition by canonical, report_date) as lo, max(rescaled) over (partition by canonical, report_date) as hi from conv) where r = 1),
iv as (select user_id, cast(min(ts) as date) as started_on, case when user_id % 5 <> 0 then cast(max(ts) as date) end as stopped_on from events group by user_id)
"""
