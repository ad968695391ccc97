"""Scans, lookups, predicates and joins of the measurement model, one query each; SQL holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.text import in_order, normalize_name
from assayframe.operators import facts, overlays
from assayframe.plans import derived as d
from assayframe.plans import measurements as m
from assayframe.sources import model

PICKED = ("widget", "ring", "anvil", "unknown")
ANCHOR = "1999-01-01"
#: Curated sets of metrics that are shown together.
PAIRINGS = [("Fasteners", ["ring", "bolt", "rivet"]), ("Drive", ["gear", "rod", "anvil"]), ("Lone", ["plate", "spring"])]


def scan_project(spark, sf_dir):
    return model.reports(spark, sf_dir).select("report_id", "provider", "report_date")


def point_lookup(spark, sf_dir, report_id=7):
    return scan_project(spark, sf_dir).where(F.col("report_id") == report_id).limit(1)


def flag_guard(spark, sf_dir):
    """Flags outside high, low and ok are null."""
    raw = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "low").otherwise("normal")
    rows = model.table(spark, sf_dir, "lineitem").select(raw.alias("raw"))
    return rows.groupBy("raw", facts.guarded_flag(F.col("raw")).alias("flag")).agg(F.count("*").alias("n"))


def flagged_rows(spark, sf_dir):
    return m.fact(spark, sf_dir).where(facts.is_flagged(F.col("flag"))).groupBy("report_id").agg(F.count("*").alias("n_flagged"))


def in_list(spark, sf_dir):
    return m.mapped(spark, sf_dir).where(F.col("canonical").isin(*PICKED)).groupBy("canonical").agg(F.count("*").alias("n"))


def or_predicate(spark, sf_dir, canonical="ring", name="cold bolt"):
    """Rows of a metric, or of the exact raw name."""
    rows = m.fact(spark, sf_dir).where((F.col("canonical") == canonical) | (F.col("name") == name))
    return rows.groupBy("canonical", "name").agg(F.count("*").alias("n"))


def date_window(spark, sf_dir, since="1996-01-01", until="1996-12-31"):
    return scan_project(spark, sf_dir).where(F.col("report_date").between(F.to_date(F.lit(since)), F.to_date(F.lit(until))))


def null_predicate(spark, sf_dir):
    return m.fact(spark, sf_dir).groupBy(F.col("value").isNull().alias("is_text"), F.col("units").isNotNull().alias("has_unit")).agg(F.count("*").alias("n"))


def search_like(spark, sf_dir, text="R_d w"):
    """Names that contain the text in any case; % and _ in it are wildcards."""
    names = model.table(spark, sf_dir, "part").where(F.col("p_name").ilike(f"%{text}%"))
    return names.groupBy("p_name").agg(F.count("*").alias("n"))


def semi_join_provider(spark, sf_dir):
    """Rows of reports whose provider, in lower case, is among those with an alias of their own."""
    scoped = model.aliases(spark, sf_dir).where("alias_provider <> ''").select(F.lower("alias_provider").alias("p")).distinct()
    rows = m.fact(spark, sf_dir).withColumn("low", F.lower("provider"))
    return rows.join(scoped, rows["low"] == scoped["p"], "left_semi").groupBy("provider").agg(F.count("*").alias("n"))


def parse_id_list(spark, sf_dir, most=4):
    """Positive ids of a printed list, the first four."""
    o = model.table(spark, sf_dir, "orders")
    printed = F.concat_ws(",", "o_custkey", F.lit("x"), -F.col("o_orderkey"), F.lit(" 12 "), F.lit(""), "o_orderkey", F.lit("1.5"), F.lit("5"), F.lit("6"))
    whole = F.filter(F.split(printed, ","), lambda t: F.trim(t).rlike(r"^\d+$"))
    ids = F.filter(F.transform(whole, lambda t: F.trim(t).try_cast("long")), lambda i: i > 0)
    return o.select("o_orderkey", F.array_join(F.slice(ids, 1, most).cast("array<string>"), ",").alias("ids"))


def _catalog(spark, sf_dir):
    """Metrics that the parts' names stand for: category by the part's first type, tags by its brands."""
    return model.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("canonical")).agg(F.lower(F.min("p_type")).alias("category"), F.array_sort(F.collect_set("p_brand")).alias("tags"))  # a name's brands


def chip_filter(spark, sf_dir, categories=("economy",), tags=("Brand#13",), text="r"):
    """Metrics of any chosen category or tag whose name or category holds the text."""
    chosen = F.col("category").isin(*categories) | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    return _catalog(spark, sf_dir).where(chosen & (F.lower("canonical").contains(text) | F.lower("category").contains(text))).select("canonical", "category")


def picker(spark, sf_dir, text="i", most=20):
    """Metrics that aren't picked yet and match the text, the first twenty by name."""
    picked = F.split("canonical", " ")[1].isin(*PICKED)
    found = _catalog(spark, sf_dir).where(~picked & (F.col("canonical").contains(text) | F.col("category").contains(text)))
    return found.orderBy(in_order(F.col("canonical"))).limit(most).select("canonical", "category")


def range_filter(spark, sf_dir, days=730):
    """Series points of the last days before the anchor."""
    points = m.metric_series_points(spark, sf_dir)
    return points.where(F.col("report_date") >= F.date_sub(F.to_date(F.lit(ANCHOR)), days)).select("canonical", "report_date", "value")


def low_confidence(spark, sf_dir, least=0.95):
    """Metrics of stored JSON whose confidence is a number below the bound; they lie in report.metrics or in metrics."""
    cell = F.concat(F.lit('{"name":"x","confidence":'), F.when(F.col("l_linenumber") == 3, F.lit('"0.1"')).otherwise((1 - F.col("l_discount")).cast("string")), F.lit("}"))
    body = F.concat(F.lit('{"metrics":['), cell, F.lit("]}"))
    raw = F.when(F.col("l_linenumber") == 1, F.concat(F.lit('{"report":'), body, F.lit("}"))).when(F.col("l_linenumber") == 2, "{broken").otherwise(body)
    rows = model.table(spark, sf_dir, "lineitem").select("l_orderkey", F.try_parse_json(raw).alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.report.metrics", "array<variant>"), F.try_variant_get("v", "$.metrics", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.select("l_orderkey", F.explode(listed).alias("x"))
    number = F.when(F.schema_of_variant(F.try_variant_get("x", "$.confidence", "variant")) != "STRING", F.try_variant_get("x", "$.confidence", "double"))
    return rows.where(number < least).groupBy("l_orderkey").agg(F.count("*").alias("n_low"))


def selection_toggle(spark, sf_dir, selected=("red ring", "small gear", "new rod")):
    """The selection after each category is toggled: all its ids go if all were in, else all come in; in long form."""
    chosen = F.col("canonical").isin(*selected)
    c = _catalog(spark, sf_dir).select("category", "canonical", chosen.alias("chosen"))
    toggled = c.groupBy("category").agg(F.bool_and("chosen").alias("whole"))
    comes = c.join(toggled, "category").where("not whole").select("category", "canonical")
    names = F.explode(F.array(*[F.lit(x) for x in selected]))
    kept = toggled.select("category", names.alias("canonical")).join(c.select("category", "canonical", F.lit(True).alias("own")), ["category", "canonical"], "left").where("own is null").select("category", "canonical")
    return comes.unionByName(kept)


def export_preselect(spark, sf_dir):
    """Metrics with a flagged row in the year before the anchor."""
    until = F.to_date(F.lit(ANCHOR))
    rows = m.mapped(spark, sf_dir).where(F.col("report_date").between(F.add_months(until, -12), until))
    return rows.groupBy("canonical").agg(F.count_if(facts.is_flagged(F.col("flag"))).alias("n_flagged")).where("n_flagged > 0")


def fact_header_join(spark, sf_dir):
    return model.metrics(spark, sf_dir).join(model.reports(spark, sf_dir), "report_id").groupBy("provider").agg(F.count("*").alias("n"))


def fact_dim_left(spark, sf_dir):
    rows = m.fact(spark, sf_dir).join(F.broadcast(model.canonicals(spark).select("canonical", "category")), "canonical", "left")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def three_way_join(spark, sf_dir):
    return m.with_category(spark, sf_dir).groupBy("category", "provider").agg(F.count("*").alias("n"), F.max("report_date").alias("newest"))


def event_intervention(spark, sf_dir):
    """Events of the window with their intervention's start, if they belong to one."""
    day = F.to_date("ts")
    marks = model.table(spark, sf_dir, "events").where(day.between(F.to_date(F.lit(d.SINCE)), F.to_date(F.lit(d.UNTIL))))
    marks = marks.select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("interval_id"))
    iv = m.interventions(spark, sf_dir).select(F.col("user_id").alias("interval_id"), "started_on")
    return marks.join(iv, "interval_id", "left").select("event_id", "interval_id", "started_on")


def alias_resolve(spark, sf_dir):
    """The metric of each distinct name and provider."""
    names = model.metrics(spark, sf_dir).join(model.reports(spark, sf_dir), "report_id").select(normalize_name(F.col("name")).alias("key"), "provider").distinct()
    return facts.resolve(names, model.aliases(spark, sf_dir))


def suggested_pairings(spark, sf_dir):
    """Curated sets with two metrics at least that rows are mapped to, in curated order, with the rows of each."""
    known = m.mapped(spark, sf_dir).groupBy("canonical").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame(PAIRINGS, "title string, names array<string>").select("title", F.posexplode("names").alias("pos", "canonical"))
    kept = known.join(F.broadcast(asked), "canonical").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("ms"), F.sum("n").alias("n_rows"))  # a set's metrics
    return kept.where(F.size("ms") >= 2).select("title", F.array_join(F.transform("ms", lambda x: x["canonical"]), ",").alias("metrics"), "n_rows")


def singletons(spark, sf_dir):
    """Events that belong to no intervention, newest first."""
    rows = model.table(spark, sf_dir, "events").where(F.col("user_id") % 3 == 0).select("event_id", F.to_date("ts").alias("day"), "event_type")
    return rows.orderBy(F.desc("day"), F.desc("event_id"))


def active_interventions(spark, sf_dir):
    """Open ones by start, newest first, then closed ones by end, newest first."""
    rows = m.interventions(spark, sf_dir).withColumn("active", F.col("stopped_on").isNull())
    by = F.when(F.col("active"), F.col("started_on")).otherwise(F.col("stopped_on"))
    return rows.withColumn("ordered_by", by).orderBy(F.desc("active"), F.desc("ordered_by"), F.desc("user_id"))


def intervention_events(spark, sf_dir):
    """What a command emits: start and stop always, change only if the dose differs. Commands are the events of a user."""
    rows = model.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "purchase", "change")
    dose, old = F.floor(F.col("value") / 5).cast("long"), (F.col("user_id") % 4).cast("long")
    text = overlays.event_text(kind, F.concat(F.lit("user "), F.col("user_id")), old, dose)
    return rows.select("event_id", kind.alias("kind"), text.alias("description")).where("description is not null")


CATALOG = "(select p_name as canonical, lower(min(p_type)) as category, list(distinct p_brand) as tags from part group by p_name)"
SQL = {
    "scan_project": "select report_id, provider, report_date from reports",
    "point_lookup": "select report_id, provider, report_date from reports where report_id = 7",
    "flag_guard": "select raw, case when raw in ('high', 'low', 'ok') then raw end as flag, count(*) as n from (select case l_returnflag when 'R' then 'high' when 'A' then 'low' else 'normal' end as raw from lineitem) group by 1, 2",
    "flagged_rows": "select report_id, count(*) as n_flagged from fact where flag in ('high', 'low') group by report_id",
    "in_list": f"select canonical, count(*) as n from fact where canonical in {PICKED} group by canonical",
    "or_predicate": "select canonical, name, count(*) as n from fact where canonical = 'ring' or name = 'cold bolt' group by all",
    "date_window": "select report_id, provider, report_date from reports where report_date between date '1996-01-01' and date '1996-12-31'",
    "null_predicate": "select value is null as is_text, units is not null as has_unit, count(*) as n from fact group by all",
    "search_like": "select p_name, count(*) as n from part where p_name ilike '%R_d w%' group by p_name",
    "semi_join_provider": "select provider, count(*) as n from fact where lower(provider) in (select lower(alias_provider) from aliases where alias_provider <> '') group by provider",
    "parse_id_list": "select o_orderkey, array_to_string(list_filter([o_custkey, 12, o_orderkey, 5, 6], lambda x: x > 0)[1:4], ',') as ids from orders",
    "chip_filter": f"select canonical, category from {CATALOG} where (category = 'economy' or list_contains(tags, 'Brand#13')) and (canonical like '%r%' or category like '%r%')",
    "picker": f"select canonical, category from {CATALOG} where split_part(canonical, ' ', 2) not in {PICKED} and (canonical like '%i%' or category like '%i%') order by canonical collate en limit 20",
    "range_filter": f"select canonical, report_date, value from pts where report_date >= date '{ANCHOR}' - 730",
    "low_confidence": "select l_orderkey, count(*) as n_low from lineitem where l_linenumber not in (2, 3) and 1 - l_discount < 0.95 group by l_orderkey",
    "selection_toggle": f""", c as (select * from {CATALOG}), t as (select category, bool_and(canonical in ('red ring', 'small gear', 'new rod')) as whole from c group by category)
select c.category, c.canonical from c join t using (category) where not whole
union all select t.category, x.name from t, (values ('red ring'), ('small gear'), ('new rod')) as x(name) where not exists (select 1 from c where c.category = t.category and c.canonical = x.name)""",
    "export_preselect": f"select canonical, n_flagged from (select canonical, count(*) filter (where flag in ('high', 'low')) as n_flagged from fact where canonical is not null and report_date between date '{ANCHOR}' - interval 1 year and date '{ANCHOR}' group by canonical) where n_flagged > 0",
    "fact_header_join": "select provider, count(*) as n from metrics join reports using (report_id) group by provider",
    "fact_dim_left": "select category, count(*) as n from fact left join canonicals using (canonical) group by category",
    "three_way_join": "select category, provider, count(*) as n, max(report_date) as newest from fact join canonicals using (canonical) group by all",
    "event_intervention": f"select event_id, interval_id, started_on from (select event_id, case when user_id % 3 <> 0 then user_id end as interval_id from events where cast(ts as date) between date '{d.SINCE}' and date '{d.UNTIL}') e left join iv on iv.user_id = e.interval_id",
    "alias_resolve": "select distinct key, provider, canonical from fact",
    "suggested_pairings": "select title, string_agg(name, ',' order by pos) as metrics, cast(sum(n) as bigint) as n_rows from (select title, unnest(names) as name, generate_subscripts(names, 1) as pos from (values " + ", ".join(f"('{t}', {n})" for t, n in PAIRINGS) + ") as p(title, names)) join (select canonical, count(*) as n from fact where canonical is not null group by canonical) on name = canonical group by title having count(*) >= 2",
    "singletons": "select event_id, cast(ts as date) as day, event_type from events where user_id % 3 = 0",
    "active_interventions": "select user_id, started_on, stopped_on, stopped_on is null as active, coalesce(stopped_on, started_on) as ordered_by from iv",
    "intervention_events": "select event_id, kind, case kind when 'start' then 'Started user ' || user_id || ' (' || dose || ')' when 'stop' then 'Stopped user ' || user_id when 'change' then 'Changed user ' || user_id || ': ' || old || ' to ' || dose end as description from (select event_id, user_id, case event_type when 'signup' then 'start' when 'error' then 'stop' when 'purchase' then 'change' end as kind, cast(floor(value / 5) as bigint) as dose, user_id % 4 as old from events) where kind in ('start', 'stop') or (kind = 'change' and dose <> old)",
}
