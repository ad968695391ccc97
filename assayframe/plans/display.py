"""Display functions and the reading of printed reports, one query each; SQL holds the same, or what the lines were printed from."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.functions import reports as rp
from assayframe.functions import text as t
from assayframe.functions import tokens
from assayframe.operators import diff, mapping, printed
from assayframe.plans import measurements as m
from assayframe.resources import load
from assayframe.sources import model


def _counted(rows, *names):
    return rows.groupBy(*names).agg(F.count("*").alias("n"))


def normalize_name(spark, sf_dir):
    return _counted(model.metrics(spark, sf_dir).select("name", t.normalize_name(F.col("name")).alias("key")), "name", "key")


def unit_factor(spark, sf_dir):
    """Factor and display unit of each metric and unit that occur."""
    pairs = m.mapped(spark, sf_dir).select("canonical", "unit_key").distinct()
    return pairs.join(F.broadcast(model.factors(spark)), ["canonical", "unit_key"], "left").select("canonical", "unit_key", "factor", "display_unit")


def blank_units(spark, sf_dir):
    """Units without white space around; blank is null."""
    padded = F.when(F.col("l_suppkey") % 3 == 0, "  ").when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit(" mg/"), "l_returnflag", F.lit("\t")))
    return _counted(model.table(spark, sf_dir, "lineitem").select(t.text_or_null(padded).alias("unit")), "unit")


def render_unit(spark, sf_dir):
    """Greek mu as the micro sign."""
    return _counted(model.metrics(spark, sf_dir).select(F.translate(F.translate("units", "µ", "μ"), "μ", "µ").alias("unit")), "unit")


def coerce_tags(spark, sf_dir):
    c, k = model.table(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = F.when(k % 4 == 0, "[broken").when(k % 4 == 1, '{"a":1}').otherwise(F.concat(F.lit('["x",1,null,"'), "c_mktsegment", F.lit('"]')))
    return c.select("c_custkey", F.array_join(t.coerce_tags(raw), ",").alias("tags"))


def parse_date(spark, sf_dir):
    """Milliseconds of a date as text; null if it isn't one."""
    raw = F.when(F.col("o_orderkey") % 7 == 0, "1998-13-40").when(F.col("o_orderkey") % 7 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.try_to_date(raw, "yyyy-MM-dd").cast("timestamp")).alias("ms"))


def format_value(spark, sf_dir):
    v = F.col("o_totalprice") / F.when(F.col("o_orderkey") % 3 == 0, 1000.0).otherwise(1.0)
    v = F.when(F.col("o_orderkey") % 5 == 0, F.floor(v).cast("double")).otherwise(v)
    return model.table(spark, sf_dir, "orders").select("o_orderkey", t.format_value(v).alias("shown"))


def js_number(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice") * 1000.0).when(F.col("o_orderkey") % 3 == 1, (F.col("o_orderkey") % 1000) / 1048576.0).otherwise(F.col("o_totalprice"))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", t.js_number(v).cast("double").alias("value"), (~t.js_number(v).contains("E") & ~t.js_number(v).endswith(".0")).alias("plain"))


def format_range(spark, sf_dir):
    low, high = (F.when(F.col("l_partkey") % k != 0, F.col(c)) for k, c in ((3, "l_tax"), (4, "l_quantity")))
    rows = model.table(spark, sf_dir, "lineitem").select(low.alias("low"), high.alias("high")).groupBy("low", "high").agg(F.count("*").alias("n"))
    # Equal pairs are printed once.
    return rows.groupBy(t.format_range(F.col("low"), F.col("high"), t.format_value).alias("range")).agg(F.sum("n").alias("n"))


def format_bytes(spark, sf_dir):
    n = (F.col("o_totalprice") * F.element_at(F.array(F.lit(0.001), F.lit(1.0), F.lit(500.0)), (F.col("o_orderkey") % 3 + 1).cast("int"))).cast("long")
    return model.table(spark, sf_dir, "orders").select("o_orderkey", t.format_bytes(F.when(F.col("o_orderkey") % 10 != 0, n)).alias("size"))


def csv_cell(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(", x"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('say "'), "p_name", F.lit('"'))).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit("\n"))).otherwise(F.col("p_name"))
    return model.table(spark, sf_dir, "part").select("p_partkey", t.csv_cell(raw).alias("cell"))


def provider_colors(spark, sf_dir):
    """A colour for each provider: its own, or for others those of a fixed list in turn, by first report."""
    seen = model.reports(spark, sf_dir).groupBy("provider").agg(F.min("report_id").alias("seen"))
    known = F.create_map(*[F.lit(x) for kv in load("provider_colors")["own"].items() for x in kv])
    rows = seen.withColumn("own", F.element_at(known, F.lower(F.trim("provider"))))
    turn = F.row_number().over(W.partitionBy(F.col("own").isNull()).orderBy("seen")) + 1  # a row a provider
    palette = F.array(*[F.lit(c) for c in load("provider_colors")["palette"][:-1]])
    return rows.select("provider", F.coalesce("own", F.element_at(palette, turn % (len(load("provider_colors")["palette"]) - 1) + 1)).alias("color"))


def known_slugs(spark, sf_dir):
    """Segments and categories that are category slugs, with their labels."""
    slugs = model.table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("slug")).union(model.canonicals(spark).select("category"))
    return _counted(slugs.select("slug", F.col("slug").isin(*mapping.CATEGORIES).alias("known"), t.category_label(F.col("slug")).alias("label")), "slug", "known", "label")


def pct_delta(spark, sf_dir):
    old = F.when(F.col("l_linenumber") != 7, F.when(F.col("l_linenumber") == 6, 0.0).otherwise(F.col("l_quantity")))
    return model.table(spark, sf_dir, "lineitem").groupBy(t.percent_change(old, F.col("l_quantity") + F.col("l_linenumber") - 3).alias("change")).agg(F.count("*").alias("n"))


def diff_name(spark, sf_dir):
    raw = F.concat(F.upper("p_name"), F.lit("  SPP. "))
    return _counted(model.table(spark, sf_dir, "part").select(diff.plain_name(raw).alias("name")), "name")


def value_equiv(spark, sf_dir):
    """Whether values and units of a row and its shifted copy are equal in the sense of the diff."""
    n = F.col("l_linenumber")
    text = lambda c: F.when(n == 7, c)
    moved = F.col("l_quantity") * F.when(n == 1, 1.05).when(n == 2, 1.1).otherwise(1.0)
    same = diff.values_equal(F.col("l_quantity"), moved, text(F.lit("Positive")), F.when(n.isin(6, 7), "POSITIVE"))
    unit = diff.units_equal(F.when(n != 3, "MG / dL"), F.when(n != 4, "mg/dl"))
    return _counted(model.table(spark, sf_dir, "lineitem").select(n.cast("long").alias("line"), same.alias("same"), unit.alias("unit")), "line", "same", "unit")


def content_hash(spark, sf_dir):
    """SHA-256 and bytes of each document, as of an uploaded file."""
    docs = model.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def raw_json_fetch(spark, sf_dir, event_id=5, user_id=None):
    """The stored JSON of one extraction, if it belongs to the owner asked for."""
    rows = model.table(spark, sf_dir, "events").where(F.col("event_id") == event_id)
    return (rows if user_id is None else rows.where(F.col("user_id") == user_id)).select("event_id", F.to_json(F.struct("event_type", F.from_json("props", "k long").alias("props"))).alias("raw"))


# Printed reports: what the lines below are read from.
def _lines(spark, sf_dir):
    """A report an order: two headings, then for each row its name and value on one line, or on two."""
    num = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    rows = model.metrics(spark, sf_dir)
    one = F.concat(F.trim("name"), F.lit("  "), F.coalesce(num("value"), F.lit("<dl")), F.when(F.col("flag") == "high", " H").otherwise(""), F.lit("  "), num("ref_low"), F.lit(" - "), num("ref_high"))
    two = F.array(F.trim("name"), F.concat(F.coalesce(num("value"), F.lit("<dl")), F.when(F.col("flag") == "high", " H").otherwise(""), F.lit("\t"), num("ref_low"), F.lit(" - "), num("ref_high")))
    body = rows.select("report_id", F.col("ord.l_linenumber").cast("long").alias("a"), F.struct("ord", "value", "ref_low", "ref_high", "flag").alias("b"), F.posexplode(F.when(F.col("ord.l_linenumber") % 2 == 0, two).otherwise(F.array(one))).alias("c", "line"))
    # Four lines above the rows and one between them, from one reading of the reports.
    heads = rows.select("report_id").distinct().select("report_id", F.posexplode(F.array(
        F.concat(F.lit("Collected: "), (F.col("report_id") % 12 + 1).cast("string"), F.lit("/"), (F.col("report_id") % 28 + 1).cast("string"), F.lit("/2024")), F.lit("PATHOGENS"), F.lit("Result  Reference"), F.lit("BACTERIAL PHYLA"), F.lit("VIRUSES"))).alias("c", "line"))
    above = F.col("c") < 4
    heads = heads.select("report_id", F.when(above, -1).otherwise(3).cast("long").alias("a"), F.lit(None).cast(body.schema["b"].dataType).alias("b"), F.when(above, F.col("c")).otherwise(-1).alias("c"), "line")
    return heads.unionByName(body)


def _order():
    return F.struct("a", "b", "c")


def detect_format(spark, sf_dir):
    """Whether a text is a report of the known kind: the footer and three of its headings. Texts are put together from orders."""
    k = F.col("o_orderkey")
    heads = F.concat_ws("\n", F.when(k % 2 == 0, "Diagnostic Solutions Laboratory"), F.lit("BACTERIAL PATHOGENS"), F.when(k % 3 == 0, "h. pylori"), F.when(k % 5 != 0, "FUNGI / YEAST"))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", rp.is_report(heads).alias("known"))


def report_date(spark, sf_dir):
    found = rp.collected_on(F.col("line"))
    return _lines(spark, sf_dir).where(found.isNotNull()).select("report_id", found.alias("day"))


def section_carry(spark, sf_dir):
    """Lines under each panel: a heading holds until the next one; banners, noise and headings are no rows."""
    # Lines are matched once and stay behind: what is sorted by report is their places and what they are.
    line = F.col("line")
    rows = _lines(spark, sf_dir).select("report_id", "a", "b", "c", rp.section(line).alias("heading"), (rp.is_noise(line) | rp.is_banner(line)).alias("idle"))
    panel = F.last("heading", ignorenulls=True).over(W.partitionBy("report_id").orderBy(_order()))  # one report's lines
    rows = rows.withColumn("panel", panel).where(F.col("heading").isNull() & ~F.col("idle"))
    return rows.groupBy("report_id", "panel").agg(F.count("*").alias("n_lines"))


def tokenize(spark, sf_dir):
    parts = F.array_join(tokens.line_tokens(F.concat(F.lit(" "), "p_name", F.lit("\t\t"), F.lower("p_type"), F.lit("    x y "), F.lit("\t "))), "|")
    return model.table(spark, sf_dir, "part").select("p_partkey", parts.alias("tokens"))


def classify_value(spark, sf_dir):
    """Printed values read again: number, text and flag."""
    n = F.col("l_linenumber")
    raw = F.when(n == 1, F.concat(F.lit("H "), F.col("l_quantity").cast("string"))).when(n == 2, F.concat(F.lit(">"), F.col("l_quantity").cast("string"))).when(n == 3, "<1.0 <dl L").when(n == 4, "not detected").when(n == 5, "DETECTED ↑").otherwise("trace")
    v = tokens.value_token(raw)
    return _counted(model.table(spark, sf_dir, "lineitem").select(v["numeric"].alias("numeric"), v["text"].alias("text"), v["flag"].alias("flag")), "numeric", "text", "flag")


def parse_range(spark, sf_dir):
    """Printed ranges read again: ends and unit."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    raw = F.when(n == 1, F.concat(F.lit("1.5 - "), q, F.lit("org/g 1.5 - "), q)).when(n == 2, F.concat(F.lit("< "), q, F.lit(" ng/mL"))).when(n == 3, F.concat(F.lit("> "), q)).otherwise("Negative")
    rows = model.table(spark, sf_dir, "lineitem").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    # Equal texts are read once.
    read = rows.select(tokens.range_token(F.col("raw")).alias("r"), "n").select("r.low", "r.high", "r.units", "n")
    return read.groupBy("low", "high", "units").agg(F.sum("n").alias("n"))


def row_shape(spark, sf_dir):
    """Shapes of lines by their tokens."""
    parts = tokens.line_tokens(F.col("line"))
    rows = _lines(spark, sf_dir).where("b is not null").select(rp.leads_with_value(parts).alias("leads"), rp.is_value_only(parts).alias("value_only"), rp.is_name_only(parts).alias("name_only"))
    return _counted(rows, "leads", "value_only", "name_only")


def parse_report(spark, sf_dir):
    """Rows of printed reports: panel, name, value, flag and range; of a panel's equal names the first."""
    rows = printed.read_reports(_lines(spark, sf_dir).select("report_id", _order().alias("at"), "line")).withColumn("name", F.lower("name"))
    return rows.groupBy("panel", "name", "flag").agg(F.count("*").alias("n"), F.sum(F.col("numeric").cast("decimal(18,4)")).cast("double").alias("total"), F.sum(F.col("low").cast("decimal(18,4)")).cast("double").alias("low"), F.sum(F.col("high").cast("decimal(18,4)")).cast("double").alias("high"))


def clean_name(spark, sf_dir):
    """Names that were printed twice, or with an open bracket at the end."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat("p_name", F.lit("  "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" (EDN,"))).when(k == 2, F.concat("p_name", F.lit(" "), "p_name", F.lit(" Count,"))).otherwise(F.col("p_name"))
    return model.table(spark, sf_dir, "part").select("p_partkey", rp.clean_name(raw).alias("name"))


def json_slice(spark, sf_dir):
    """The JSON inside an answer with words or fences around it."""
    raw = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return model.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(rp.json_part(raw)), "$.k", "long").alias("k"))


def page_rows(spark, sf_dir):
    """Text rows of a page from placed pieces: equal pieces once, rows of near height, a tab where the gap is wide."""
    n = model.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    items = n.select("page", (F.col("line") * 4.0 + 0.3).alias("y"), F.explode(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(20.0).alias("w"), F.col("line").cast("string").alias("s")), F.struct(F.lit(24.0).alias("x"), F.lit(10.0).alias("w"), F.lit("b").alias("s")), F.struct(F.lit(60.0).alias("x"), F.lit(5.0).alias("w"), F.lit("c").alias("s")))).alias("p")).select("page", "y", "p.*")
    return rp.page_rows(items).groupBy("line").agg(F.count("*").alias("n"))


VALUE = "case when {v} is null then null when abs({v}) >= 100 and {v} = floor({v}) then cast(cast({v} as bigint) as varchar) else regexp_replace(regexp_replace(printf('%.3f', {v}), '0+$', ''), '[.]$', '') end"
LOW, HIGH = "case when l_partkey % 3 <> 0 then l_tax end", "case when l_partkey % 4 <> 0 then l_quantity end"
SLUG = "lower(c_mktsegment)"
PRINTED = "(select *, ord[2] as line, case when ord[2] < 3 then 'Bacterial Phyla' else 'Viruses' end as panel, lower(trim(name)) as k from metrics)"
SQL = {
    "normalize_name": "select name, lower(trim(name)) as key, count(*) as n from metrics group by name",
    "unit_factor": "select canonical, unit_key, cast(factor as double) as factor, display_unit from (select distinct canonical, unit_key from fact where canonical is not null) left join factors using (canonical, unit_key)",
    "blank_units": "select case when l_suppkey % 3 = 1 then 'mg/' || l_returnflag end as unit, count(*) as n from lineitem group by 1",
    "render_unit": "select units as unit, count(*) as n from metrics group by 1",
    "coerce_tags": "select c_custkey, case when c_custkey % 4 < 2 then '' else 'x,' || c_mktsegment end as tags from customer",
    "parse_date": "select o_orderkey, case when o_orderkey % 7 > 1 then epoch_ms(cast(cast(o_orderdate as date) as timestamp)) end as ms from orders",
    "format_value": f"select o_orderkey, {VALUE.format(v='v')} as shown from (select o_orderkey, case when o_orderkey % 5 = 0 then floor(u) else u end as v from (select o_orderkey, o_totalprice / case when o_orderkey % 3 = 0 then 1000.0::double else 1.0::double end as u from orders))",
    "js_number": "select o_orderkey, case o_orderkey % 3 when 0 then floor(o_totalprice) * 1000 when 1 then (o_orderkey % 1000) / 1048576.0::double else o_totalprice end as value, true as plain from orders",
    "format_range": f"select case when lo is not null and hi is not null then ({VALUE.format(v='lo')}) || '–' || ({VALUE.format(v='hi')}) when lo is not null then '≥ ' || ({VALUE.format(v='lo')}) when hi is not null then '≤ ' || ({VALUE.format(v='hi')}) else '—' end as range, count(*) as n from (select {LOW} as lo, {HIGH} as hi from lineitem) group by 1",
    "format_bytes": "select o_orderkey, case when o_orderkey % 10 = 0 then '—' when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', round(b / 1024.0::double, 1)) else printf('%.1f MB', round(b / 1048576.0::double, 1)) end as size from (select o_orderkey, cast(trunc(o_totalprice * case o_orderkey % 3 when 0 then 0.001::double when 1 then 1.0::double else 500.0::double end) as bigint) as b from orders)",
    "csv_cell": "select p_partkey, case p_partkey % 4 when 0 then '\"' || p_name || ', x\"' when 1 then '\"say \"\"' || p_name || '\"\"\"' when 2 then '\"' || p_name || chr(10) || '\"' else p_name end as cell from part",
    "provider_colors": "select provider, " + str(load("provider_colors")["palette"][:-1]) + "[cast((row_number() over (order by seen) + 1) % 7 + 1 as integer)] as color from (select provider, min(report_id) as seen from reports group by provider)",
    "known_slugs": f"select slug, slug in {tuple(mapping.CATEGORIES)} as known, {t.LABEL_SQL.replace('category', 'slug')} as label, count(*) as n from (select {SLUG} as slug from customer union all select category from canonicals) group by all",
    "pct_delta": "select case when o is null or o = 0 then '—' else case when v >= o then '+' else '' end || printf('%.1f', round((v - o) / o * 100, 1)) || '%' end as change, count(*) as n from (select case when l_linenumber <> 7 then case when l_linenumber = 6 then 0 else l_quantity end end as o, l_quantity + l_linenumber - 3 as v from lineitem) group by 1",
    "diff_name": "select p_name || ' spp' as name, count(*) as n from part group by 1",
    "value_equiv": "select cast(l_linenumber as bigint) as line, l_linenumber not in (2, 6) as same, l_linenumber not in (3, 4) as unit, count(*) as n from lineitem group by all",
    "content_hash": "select doc_id, sha256(coalesce(text, '')) as file_hash, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes from documents",
    "raw_json_fetch": "select event_id, '{\"event_type\":\"' || event_type || '\",\"props\":{\"k\":' || json_extract_string(props, '$.k') || '}}' as raw from events where event_id = 5",
    "detect_format": "select o_orderkey, o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 as known from orders",
    "report_date": "select distinct report_id, '2024-' || lpad(cast(report_id % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(report_id % 28 + 1 as varchar), 2, '0') as day from metrics",
    "section_carry": "select report_id, case when ord[2] < 3 then 'Bacterial Phyla' else 'Viruses' end as panel, sum(case when ord[2] % 2 = 0 then 2 else 1 end)::bigint as n_lines from metrics group by all",
    "tokenize": "select p_partkey, p_name || '|' || lower(p_type) || '|x y' as tokens from part",
    "classify_value": "select case when l_linenumber < 3 then l_quantity end as numeric, case l_linenumber when 1 then null when 2 then '>' || cast(l_quantity as varchar) when 3 then '<dl' when 4 then 'Not Detected' when 5 then 'Detected' else 'trace' end as text, case l_linenumber when 1 then 'high' when 3 then 'low' when 5 then 'high' end as flag, count(*) as n from lineitem group by all",
    "parse_range": "select case l_linenumber when 1 then 1.5 when 3 then l_quantity end as low, case when l_linenumber in (1, 2) then l_quantity end as high, case l_linenumber when 1 then 'org/g' when 2 then 'ng/mL' end as units, count(*) as n from lineitem group by all",
    "row_shape": "select shape = 'value' as leads, shape = 'value' as value_only, shape = 'name' as name_only, count(*) as n from (select unnest(case when ord[2] % 2 = 0 then ['name', 'value'] else ['whole'] end) as shape from metrics) group by all",
    "parse_report": f"select panel, trim(any_value(k)) as name, flag, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total, cast(sum(cast(cast(ref_low as decimal(12,2)) as decimal(18,4))) as double) as low, cast(sum(cast(cast(ref_high as decimal(12,2)) as decimal(18,4))) as double) as high from (select panel, k, case when flag = 'high' then 'high' end as flag, value, ref_low, ref_high, row_number() over (partition by report_id, panel, k order by line, ord, value, ref_low, ref_high, flag) as r from {PRINTED}) where r = 1 group by panel, k, flag",
    "clean_name": "select p_partkey, p_name || case when p_partkey % 4 = 2 then ' Count' else '' end as name from part",
    "json_slice": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "page_rows": "select line, count(*) as n from (select distinct l_orderkey, cast(l_linenumber as varchar) || ' b' || chr(9) || 'c' as line from lineitem) group by line",
}
