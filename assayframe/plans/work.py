"""Upload batches, mapping runs, proposals and the taxonomy, one query each; SQL holds the same for DuckDB.

The work tables are read off the driver's tables: a batch is a customer, its items are orders, and a proposal is what a
rule says about a part's name.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.functions.text import normalize_name
from assayframe.operators import ingest, parsers
from assayframe.operators import mapping as mp
from assayframe.operators.ranking import numbered
from assayframe.plans import measurements as m
from assayframe.plans.derived import SINCE, UNTIL, marker_semi
from assayframe.sources import model

NOW = "1998-06-01 00:10:00"
SEED = [("ring", "cbc"), ("bolt", "lipids"), ("gear", "cbc"), ("spring", "other")]
SEED_ALIASES = [("ring", "red ring"), ("ring", "steel ring"), ("bolt", "hot bolt"), ("gear", "brass gear"), ("spring", "red spring")]


def _items(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "extracting").otherwise(F.when(F.col("o_orderkey") % 4 == 0, "duplicate").otherwise("saved"))
    own = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), own.alias("report_id"), (F.col("o_orderkey") + 1).alias("duplicate_report_id"))


def batch_items_hydrate(spark, sf_dir):
    """Items with the report they became, or the one that they repeat."""
    reports = model.reports(spark, sf_dir).select(F.col("report_id").alias("shown"), "provider", "report_date")
    items = _items(spark, sf_dir).withColumn("shown", F.coalesce("report_id", "duplicate_report_id"))
    return items.join(reports, "shown", "left").select("item_id", "batch_id", "status", "shown", "provider", "report_date")


def status_histogram(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("batch_id", "status").agg(F.count("*").alias("n"))


def in_flight(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("batch_id").agg(F.count_if(F.col("status").isin("queued", "extracting")).alias("n_open"), F.count("*").alias("n"))


def stale_items(spark, sf_dir):
    """Items that have been in work for over 15 minutes."""
    late = F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 15 minutes")
    return _items(spark, sf_dir).where((F.col("status") == "extracting") & (F.col("updated_at") < late)).select("item_id", "batch_id")


def recent_batches(spark, sf_dir, n=20):
    return _items(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n_items")).orderBy(F.desc("batch_id")).limit(n)


def queue_head(spark, sf_dir):
    return _items(spark, sf_dir).where("status = 'queued'").orderBy("item_id").limit(1).select("item_id", "batch_id")


def reviewable_run(spark, sf_dir):
    """Of the newest five runs the newest that can be reviewed."""
    state = F.element_at(F.array(*[F.lit(s) for s in ("applied", "ready_for_review", "error", "canceled")]), (F.col("batch_id") % 4 + 1).cast("int"))
    runs = _items(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n_items")).withColumn("state", state)
    newest = runs.orderBy(F.desc("batch_id")).limit(5)
    return newest.where(F.col("state").isin("ready_for_review", "error")).orderBy(F.desc("batch_id")).limit(1).select("batch_id", "state")


def chunk_batches(spark, sf_dir, size=3):
    """Unmapped names in order, cut into batches."""
    names = m.fact(spark, sf_dir).where("canonical is null and key <> ''").select("key").distinct()
    return numbered(names, "key").select("key", F.floor((F.col("place") - 1) / size).cast("long").alias("batch"))


def _proposals(spark, sf_dir):
    """What a mapper says about each part name: to a known metric, to one that doesn't exist, a new one, or nothing."""
    names = model.table(spark, sf_dir, "part").select("p_name").distinct()
    adj, word = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    action = F.when(adj == "cold", "map_existing").when(adj == "old", "create_new").when(adj == "hot", "skip").otherwise("map_existing")
    target = F.when(adj == "cold", F.concat(F.lit("Old "), word)).when(action == "map_existing", F.upper(word))
    new = F.when(adj == "old", F.struct(
        F.concat(F.lit("Old "), word).alias("name"), F.when(word.isin("ring", "bolt"), "cbc").when(word == "gear", "bogus").otherwise("other").alias("category"),
        F.array(F.lit("longevity"), word).alias("tags"),
        F.when(word == "rod", "A mold metabolite").when(word == "plate", "An organic acid").when(word == "anvil", "A catecholamine marker").otherwise("A part").alias("description"),
        F.when(word == "widget", "mg/g creatinine").alias("units")))
    confidence = F.pmod(F.length("p_name") * 7, F.lit(10)) / 10.0
    return names.select(F.concat(F.lit(" "), F.upper("p_name")).alias("raw"), "p_name", action.alias("action"), target.alias("target"), new.alias("new"), confidence.alias("confidence"), F.lit(None).cast("string").alias("reason"))


def _sources(spark, sf_dir):
    return m.fact(spark, sf_dir).where(F.col("key").startswith("cold") | F.col("key").startswith("old")).groupBy("key").agg(F.count("*").alias("n"))


def proposal_match(spark, sf_dir):
    """Proposals whose name is among the names asked about."""
    p = _proposals(spark, sf_dir).withColumn("key", normalize_name(F.col("raw")))
    return p.join(_sources(spark, sf_dir), "key").select("key", "action", "n")


def proposal_missing(spark, sf_dir):
    """Names that were asked about and got no usable proposal (none with a confidence of 0.3 and more)."""
    p = _proposals(spark, sf_dir).where("confidence >= 0.3").select(normalize_name(F.col("raw")).alias("key"))
    return _sources(spark, sf_dir).join(p, "key", "left_anti").select("key", "n")


def _ingested(spark, sf_dir):
    return mp.ingested(_proposals(spark, sf_dir), model.canonicals(spark).select("canonical"))


def proposal_ingest(spark, sf_dir):
    """Proposals as stored: unknown targets become skips, new metrics are sanitised, and both say so."""
    return _ingested(spark, sf_dir).select("key", "action", "target", F.col("new.category").alias("category"), F.array_join("new.tags", ",").alias("tags"), "reason")


def sanitize_canonical(spark, sf_dir):
    new = _proposals(spark, sf_dir).where("new is not null")
    return new.select("p_name", mp.sanitized(F.col("new")).alias("s")).select("p_name", "s.category", F.array_join("s.tags", ",").alias("tags"), F.array_join("s.dropped", ",").alias("dropped"))


def recategorize(spark, sf_dir):
    new = _proposals(spark, sf_dir).where("new is not null")
    return new.select("p_name", mp.better_category(F.col("new")).alias("category"))


def lossy_fix(spark, sf_dir):
    """Mappings that lose a distinction become metrics of their own; names are those of the fixed list or of parts."""
    names = model.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, " Escherichia SPP. ").when(F.col("p_partkey") % 3 == 1, "pseudomonas aeruginosa").otherwise(F.col("p_name")).alias("raw"))
    fix = mp.lossy(normalize_name(F.col("raw")))
    return names.groupBy(fix["name"].alias("name"), fix["category"].alias("category")).agg(F.count("*").alias("n"))


def self_heal(spark, sf_dir):
    """New metrics with the names of skips that asked for them."""
    rows = mp.healed(_ingested(spark, sf_dir))
    return rows.select("key", "action", F.array_join("extra", ",").alias("extra"))


def fixup(spark, sf_dir):
    """Lossy mappings, then skips that heal, then better categories."""
    rows = mp.healed(mp.without_lossy(_ingested(spark, sf_dir)))
    return rows.select("key", "action", F.when(F.col("new").isNotNull(), mp.better_category(F.col("new"))).alias("category"), F.size("extra").cast("long").alias("n_extra"))


def proposal_filter(spark, sf_dir, action="map_existing", least=0.4):
    """Stored proposals of an action and a confidence, surest first."""
    rows = mp.listed(_ingested(spark, sf_dir), action=action, least=least)
    return rows.select("key", "target", "confidence")


def proposal_status(spark, sf_dir, status="approved", least=0.2):
    """Proposals that a review approved, surest first, with any action."""
    rows = mp.listed(_patched(spark, sf_dir), status=status, least=least)
    return rows.select("key", "action", "target", "status", "confidence")


def _patched(spark, sf_dir):
    n = F.length("key") % 4
    return mp.patched(_ingested(spark, sf_dir), F.when(n == 0, "ring"), F.when(n == 1, F.concat(F.lit("New "), "key")))


def proposal_patch(spark, sf_dir):
    """Proposals after a review: a chosen metric makes a mapping, a new one a creation, and any edit approves."""
    return _patched(spark, sf_dir).select("key", "action", "target", "status")


def apply_backfill(spark, sf_dir):
    """Rows and metrics after the run's proposals are applied: only rows without a metric are filled."""
    healed = mp.healed(_ingested(spark, sf_dir))
    targets = mp.alias_targets(healed).groupBy("alias").agg(F.min_by("canonical", "turn").alias("new"))
    rows = m.fact(spark, sf_dir).select("key", "canonical")
    done = rows.join(targets, rows["key"] == targets["alias"], "left")
    return done.groupBy(F.coalesce("canonical", "new").alias("canonical")).agg(F.count("*").alias("n"), F.count_if(F.col("canonical").isNull() & F.col("new").isNotNull()).alias("n_filled"))


def manual_alias_upsert(spark, sf_dir, name="red ring", target="gear"):
    """The alias table after a name is mapped by hand: its global entry is replaced or added."""
    key = normalize_name(F.lit(name))
    rest = model.aliases(spark, sf_dir).where(~((F.col("alias") == key) & (F.col("alias_provider") == "")))
    one = spark.range(1).select(key.alias("alias"), F.lit("").alias("alias_provider"), F.lit(target).alias("canonical"))
    return rest.unionByName(one).groupBy("canonical", "alias_provider").agg(F.count("*").alias("n"), F.max("alias").alias("last"))


def alias_backfill(spark, sf_dir):
    """Rows that a second look at the aliases fills, and those that stay unmapped."""
    rows = m.fact(spark, sf_dir)
    return rows.agg(F.count_if(F.col("canonical").isNotNull()).alias("n_matched"), F.count_if(F.col("canonical").isNull()).alias("n_left"), F.count_distinct(F.when(F.col("canonical").isNull(), F.col("key"))).alias("n_names"))


def _seed(spark):
    return spark.createDataFrame(SEED, "canonical string, category string"), spark.createDataFrame(SEED_ALIASES, "canonical string, alias string")


def _targets(spark, sf_dir):
    """The metrics of the store: what its aliases lead to."""
    used = model.aliases(spark, sf_dir).select("canonical").distinct()
    return used.join(F.broadcast(model.canonicals(spark)), "canonical").select("canonical", "category")


def seed_new_canonicals(spark, sf_dir):
    """Metrics of the store that the seed lacks."""
    seed, _ = _seed(spark)
    return _targets(spark, sf_dir).join(seed, "canonical", "left_anti").select("canonical", "category")


def seed_alias_additions(spark, sf_dir):
    """Aliases of the store that the seed's entry of the same metric lacks."""
    seed, aliases = _seed(spark)
    own = model.aliases(spark, sf_dir).where("alias_provider = ''").select("canonical", "alias").join(seed.select("canonical"), "canonical", "left_semi")
    return own.join(aliases, ["canonical", "alias"], "left_anti")


def seed_upsert(spark, sf_dir):
    """The taxonomy after the seed is applied: what is there stays, the rest is added."""
    seed, _ = _seed(spark)
    old = _targets(spark, sf_dir)
    return old.unionByName(seed.join(old, "canonical", "left_anti")).select("canonical", "category")


def ingest_rows(spark, sf_dir):
    """What a report's rows become when it is stored: equal rows once, names resolved, panels numbered as first seen."""
    brand = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("panel"))
    rows = m.fact(spark, sf_dir).withColumn("pk", F.col("ord.l_partkey")).join(brand, "pk", "left")
    rows = rows.select("report_id", "ord", "panel", "canonical", "name", "units", "value", "value_text", "ref_low", "ref_high", "flag")
    kept = ingest.folded(rows, ["report_id"], "ord", "name", "units", "value", "value_text", "ref_low", "ref_high", "flag")
    panels = kept.where("panel is not null").groupBy("report_id", "panel").agg(F.min("ord").alias("seen"), F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("report_id").orderBy("seen", "panel"))  # one report's panels
    return panels.select("report_id", "panel", nth.cast("long").alias("nth"), "n")


def parser_dispatch(spark, sf_dir):
    """The parser of each text: the first whose format it has; others are left to the caller."""
    k = F.col("o_orderkey")
    text = F.concat_ws("\n", F.when(k % 2 == 0, "Diagnostic Solutions Laboratory"), F.lit("BACTERIAL PATHOGENS"), F.lit("H. PYLORI"), F.lit("FUNGI/YEAST"), F.when(k % 3 == 0, "{\"metrics\": []}"))
    return model.table(spark, sf_dir, "orders").groupBy(parsers.chosen(text, parsers.REGISTRY).alias("parser")).agg(F.count("*").alias("n"))


def drawn_markers(spark, sf_dir):
    """Of the markers shown in a window only those without an intervention are drawn, each at its day."""
    return marker_semi(spark, sf_dir).where("interval_id is null").select("event_id", "day")


ITEMS = """(select o_orderkey as item_id, o_custkey as batch_id, case o_orderstatus when 'P' then 'queued' when 'O' then 'extracting' else case when o_orderkey % 4 = 0 then 'duplicate' else 'saved' end end as status, o_orderdate as updated_at,
  coalesce(case when o_orderkey % 3 <> 0 then o_orderkey end, o_orderkey + 1) as shown from orders)"""
#: Proposals as stored, each rule in the order of the text.
STORED = """(select key, adj, word, confidence,
  case adj when 'old' then 'create_new' when 'hot' then 'skip' when 'cold' then 'skip' else 'map_existing' end as action,
  case when adj = 'old' then 'Old ' || word when adj not in ('hot', 'cold') then word end as target,
  case when adj = 'old' then case when word in ('ring', 'bolt') then 'cbc' else 'other' end end as category, case when adj = 'old' then 'longevity' end as tags,
  case when adj = 'cold' then 'Mapper proposed map_existing to "Old ' || word || '" but no such canonical exists' when adj = 'old' then case when word = 'gear' then 'category "bogus" coerced to "other" · ' else '' end || 'dropped unknown tag(s): ' || word end as reason
  from (select lower(p_name) as key, split_part(p_name, ' ', 1) as adj, split_part(p_name, ' ', 2) as word, ((length(p_name) * 7) % 10) / 10.0 as confidence from (select distinct p_name from part)))"""
BETTER = "case when word in ('ring', 'bolt') then 'cbc' when word = 'rod' then 'mycotoxins' when word in ('plate', 'widget') then 'organic-acids' when word = 'anvil' then 'hormones' else {other} end"
COLD = "exists (select 1 from part q where q.p_name = 'cold ' || s.word)"
OLD = "exists (select 1 from part q where q.p_name = 'old ' || s.word)"
ASKED = "(select key, count(*) as n from fact where key like 'cold%' or key like 'old%' group by key)"
TARGETS = "(select distinct canonical, category from aliases join canonicals using (canonical))"
SQL = {
    "batch_items_hydrate": f"select item_id, batch_id, status, shown, provider, report_date from {ITEMS} left join reports on shown = report_id",
    "status_histogram": f"select batch_id, status, count(*) as n from {ITEMS} group by all",
    "in_flight": f"select batch_id, count(*) filter (where status in ('queued', 'extracting')) as n_open, count(*) as n from {ITEMS} group by batch_id",
    "stale_items": f"select item_id, batch_id from {ITEMS} where status = 'extracting' and updated_at < timestamp '{NOW}' - interval 15 minutes",
    "recent_batches": f"select batch_id, count(*) as n_items from {ITEMS} group by batch_id order by batch_id desc limit 20",
    "queue_head": f"select item_id, batch_id from {ITEMS} where status = 'queued' order by item_id limit 1",
    "reviewable_run": f"select batch_id, state from (select batch_id, ['applied', 'ready_for_review', 'error', 'canceled'][batch_id % 4 + 1] as state from {ITEMS} group by batch_id order by batch_id desc limit 5) where state in ('ready_for_review', 'error') order by batch_id desc limit 1",
    "chunk_batches": "select key, (row_number() over (order by key) - 1) // 3 as batch from (select distinct key from fact where canonical is null and key <> '')",
    "proposal_match": f"select key, case when key like 'cold%' then 'map_existing' else 'create_new' end as action, n from {ASKED} where key in (select lower(p_name) from part)",
    "proposal_missing": f"select key, n from {ASKED} where key not in (select key from {STORED} where confidence >= 0.3)",
    "proposal_ingest": f"select key, action, target, category, tags, reason from {STORED}",
    "sanitize_canonical": f"select key as p_name, category, tags, word as dropped from {STORED} where adj = 'old'",
    "recategorize": f"select key as p_name, {BETTER.format(other='''case when word = 'gear' then 'bogus' else 'other' end''')} as category from {STORED} where adj = 'old'",
    "lossy_fix": "select case p_partkey % 3 when 0 then 'Escherichia spp.' when 1 then 'Pseudomonas aeruginosa' end as name, case p_partkey % 3 when 0 then 'gi-microbiome' when 1 then 'gi-pathogens' end as category, count(*) as n from part group by all",
    "self_heal": f"select key, action, case when action = 'create_new' and {COLD} then 'cold ' || word else '' end as extra from {STORED} s where adj <> 'cold' or not {OLD}",
    "fixup": f"select key, action, case when action = 'create_new' then {BETTER.format(other=repr('other'))} end as category, cast(action = 'create_new' and {COLD} as bigint) as n_extra from {STORED} s where adj <> 'cold' or not {OLD}",
    "proposal_filter": f"select key, target, confidence from {STORED} where action = 'map_existing' and confidence >= 0.4",
    "proposal_status": f"select p.key, p.action, p.target, p.status, s.confidence from (select key, case length(key) % 4 when 0 then 'map_existing' when 1 then 'create_new' else action end as action, case length(key) % 4 when 0 then 'ring' when 1 then 'New ' || key else target end as target, case when length(key) % 4 < 2 then 'approved' else 'pending' end as status from {STORED}) p join {STORED} s using (key) where p.status = 'approved' and s.confidence >= 0.2",
    "proposal_patch": f"select key, case length(key) % 4 when 0 then 'map_existing' when 1 then 'create_new' else action end as action, case length(key) % 4 when 0 then 'ring' when 1 then 'New ' || key else target end as target, case when length(key) % 4 < 2 then 'approved' else 'pending' end as status from {STORED}",
    "apply_backfill": "select coalesce(canonical, new) as canonical, count(*) as n, count(*) filter (where canonical is null and new is not null) as n_filled from (select canonical, case when key like 'cold %' and exists (select 1 from part q where q.p_name = 'old ' || split_part(fact.key, ' ', 2)) then 'Old ' || split_part(key, ' ', 2) end as new from fact) group by 1",
    "manual_alias_upsert": "select canonical, alias_provider, count(*) as n, max(alias) as last from (select * from aliases where not (alias = 'red ring' and alias_provider = '') union all select 'red ring', '', 'gear') group by all",
    "alias_backfill": "select count(*) filter (where canonical is not null) as n_matched, count(*) filter (where canonical is null) as n_left, count(distinct key) filter (where canonical is null) as n_names from fact",
    "seed_new_canonicals": f"select canonical, category from {TARGETS} where canonical not in {tuple(c for c, _ in SEED)}",
    "seed_alias_additions": f"select canonical, alias from aliases where alias_provider = '' and canonical in {tuple(c for c, _ in SEED)} and (canonical, alias) not in {tuple(SEED_ALIASES)}",
    "ingest_rows": "select report_id, panel, row_number() over (partition by report_id order by seen, panel) as nth, n from (select report_id, x.p as panel, min(x.o) as seen, count(*) as n from (select report_id, min({'o': ord, 'p': case when ord[3] % 5 <> 0 then p_brand end, 'c': canonical}) as x from fact left join part on ord[3] = p_partkey group by report_id, key, unit_key, value, lower(trim(coalesce(value_text, '')))) where x.p is not null group by report_id, x.p)",
    "parser_dispatch": "select case when o_orderkey % 2 = 0 then 'panel-report' when o_orderkey % 3 = 0 then 'json' end as parser, count(*) as n from orders group by 1",
    "drawn_markers": f"select event_id, cast(ts as date) as day from events where cast(ts as date) between date '{SINCE}' and date '{UNTIL}' and user_id % 3 = 0",
    "seed_upsert": f"select canonical, category from {TARGETS} union select * from (values {', '.join(map(str, SEED))}) as s(canonical, category) where canonical not in (select canonical from {TARGETS})",
}
