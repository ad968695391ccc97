"""Rules on mapping proposals: what is stored, fixed up, reviewed and applied. All of it is columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import normalize_name

# Categories and tags.
CATEGORIES = [
    "cbc", "cmp", "lipids", "inflammation", "thyroid", "hormones", "nutrients", "kidney", "liver", "glycemic", "gi-microbiome", "gi-pathogens", "gi-inflammation",
    "gi-digestion", "sibo", "aging", "imaging", "organic-acids", "mycotoxins", "other",
]
TAGS = ["longevity", "cardio-risk", "autoimmunity", "methylation", "iron-status", "insulin-resistance", "gut-barrier", "sibo-theme"]
# Names whose mapping to a wider metric loses a distinction, with the metric and category of their own.
LOSSY = {"escherichia spp.": ("Escherichia spp.", "gi-microbiome"), "pseudomonas aeruginosa": ("Pseudomonas aeruginosa", "gi-pathogens")}
# Parts of mycotoxins' names, and words of descriptions, names and units by which a category is chosen.
MYCOTOXINS = ["aflatoxin", "citrinin", "enniatin", "gliotoxin", "ochratoxin", "roridin", "sterigmatocystin", "verrucarin", "zearalenone", "chaetoglobosin", "mycophenolic"]
MOLD, ORGANIC = r"\b(mycotoxin|mold|fungal exposure)\b", r"\borganic acid\b"
LIPID = r"\b(linoleic|omega|arachidonic|eicosapentaenoic|docosahexaenoic)\b"
HORMONE = r"\b(neurotransmitter|catecholamine|serotonin|dopamine|epinephrine|norepinephrine)\b"


def sanitized(new: Column) -> Column:
    """A new metric with a known category, its known tags, and the tags that were dropped."""
    known = F.array(*[F.lit(t) for t in TAGS])
    return F.struct(
        new["name"].alias("name"), F.when(new["category"].isin(*CATEGORIES), new["category"]).otherwise("other").alias("category"),
        F.filter(new["tags"], lambda t: F.array_contains(known, t)).alias("tags"), new["description"].alias("description"), new["units"].alias("units"),
        F.filter(new["tags"], lambda t: ~F.array_contains(known, t)).alias("dropped"),
    )


def better_category(new: Column) -> Column:
    """The category, or for `other` the first that name, description or units tell."""
    name, text, units = F.lower(new["name"]), F.lower(new["description"]), F.lower(F.coalesce(new["units"], F.lit("")))
    return (
        F.when(new["category"] != "other", new["category"]).when(name.rlike("|".join(MYCOTOXINS)) | text.rlike(MOLD), "mycotoxins")
        .when(text.rlike(ORGANIC) | units.contains("creatinine"), "organic-acids").when(name.rlike(LIPID), "lipids").when(text.rlike(HORMONE), "hormones").otherwise("other")
    )


def lossy(key: Column) -> Column:
    """The metric of its own for a listed name, as a struct of name and category; null for others."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in LOSSY.items() for x in (k, v[i])]), key)
    return F.struct(pick(0).alias("name"), pick(1).alias("category"))


def ingested(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """Proposals (raw, action, target, new, confidence, reason) as stored, one a name: key, action, target, new, confidence, reason.

    A mapping to a metric that doesn't exist becomes a skip, and its reason says so. Of a name's several proposals the
    surest stays, then the one of the first action."""
    names = known.select(F.lower("canonical").alias("_low"), F.col("canonical").alias("_known")).groupBy("_low").agg(F.min("_known").alias("_known"))
    rows = proposals.withColumn("key", normalize_name(F.col("raw"))).withColumn("_old", F.col("new.category")).withColumn("new", F.when(F.col("action") == "create_new", sanitized(F.col("new"))).otherwise(None))
    rows = rows.join(names, F.lower("target") == F.col("_low"), "left")
    lost = (F.col("action") == "map_existing") & F.col("_known").isNull()
    old = F.when(F.col("action") == "create_new", F.col("_old"))
    note = F.concat_ws(
        " · ", "reason", F.when(old != F.col("new.category"), F.concat(F.lit('category "'), old, F.lit('" coerced to "'), F.col("new.category"), F.lit('"'))),
        F.when(F.size("new.dropped") > 0, F.concat(F.lit("dropped unknown tag(s): "), F.array_join("new.dropped", ", "))),
    )
    told = F.concat(F.lit('Mapper proposed map_existing to "'), F.col("target"), F.lit('" but no such canonical exists'))
    rows = rows.select(
        "key", F.when(lost, "skip").otherwise(F.col("action")).alias("action"), "new", "confidence",
        F.when(F.col("action") == "create_new", F.col("new.name")).when(F.col("action") == "map_existing", F.col("_known")).alias("target"),
        F.when(lost, told).otherwise(F.nullif(note, F.lit(""))).alias("reason"),
    )
    best = F.max_by(F.struct("action", "target", "new", "confidence", "reason"), F.struct("confidence", "action")).alias("p")
    return rows.groupBy("key").agg(best).select("key", "p.*")


def without_lossy(rows: DataFrame) -> DataFrame:
    """Mappings of listed names turned into creations."""
    fix = lossy(F.col("key"))
    hit = (F.col("action") == "map_existing") & fix["name"].isNotNull()
    made = F.struct(fix["name"].alias("name"), fix["category"].alias("category"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("description"),
                    F.lit(None).cast("string").alias("units"), F.array().cast("array<string>").alias("dropped"))
    return rows.withColumns({"new": F.when(hit, made).otherwise(F.col("new")), "target": F.when(hit, fix["name"]).otherwise(F.col("target")), "action": F.when(hit, "create_new").otherwise(F.col("action"))})


def healed(rows: DataFrame) -> DataFrame:
    """Skips that asked for a metric which the same run creates go; their names become `extra` aliases of it."""
    asked = F.lower(F.nullif(F.regexp_extract("reason", r'(?i)proposed map_existing to "([^"]+)"', 1), F.lit("")))
    made = rows.where("action = 'create_new'").select(F.lower("target").alias("_made")).distinct()
    skips = rows.where("action = 'skip'").withColumn("_asked", asked)
    fits = skips.join(made, F.col("_asked") == F.col("_made")).select("key", "_asked")
    extra = fits.groupBy("_asked").agg(F.array_sort(F.collect_set("key")).alias("_extra"))  # the names of one metric
    rest = rows.join(fits.select("key"), "key", "left_anti")
    found = rest.join(extra, (F.col("action") == "create_new") & (F.lower("target") == F.col("_asked")), "left")
    return found.withColumn("extra", F.coalesce("_extra", F.array().cast("array<string>"))).drop("_asked", "_extra")


def patched(rows: DataFrame, chosen: Column, renamed: Column) -> DataFrame:
    """Proposals after edits: a chosen metric, or else the name of a new one; an edit approves."""
    action = F.when(chosen.isNotNull(), "map_existing").when(renamed.isNotNull(), "create_new").otherwise(F.col("action"))
    edited = chosen.isNotNull() | renamed.isNotNull()
    return rows.select("key", action.alias("action"), F.coalesce(chosen, renamed, F.col("target")).alias("target"), "confidence", F.when(edited, "approved").otherwise("pending").alias("status"))


def listed(rows: DataFrame, action: str | None = None, status: str | None = None, least: float | None = None) -> DataFrame:
    """Proposals of an action, a status and a confidence, each if given; surest first, then by name. No confidence is below all."""
    for column, wanted in (("action", action), ("status", status)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if least is not None:
        rows = rows.where(F.col("confidence") >= least)
    return rows.orderBy(F.desc_nulls_last("confidence"), "key")


def alias_targets(rows: DataFrame) -> DataFrame:
    """alias, canonical and turn of what a run maps: each proposal's name and its extra ones; skips map nothing."""
    named = rows.where("action <> 'skip' and target is not null")
    return named.select(F.explode(F.concat(F.array("key"), "extra")).alias("alias"), F.col("target").alias("canonical"), F.col("key").alias("turn"))
