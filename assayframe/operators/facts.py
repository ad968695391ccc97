"""The enriched fact: every observation with its report, canonical metric, unit key and group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.functions.text import canonical_unit, normalize_name


def guarded_flag(c: Column) -> Column:
    return F.when(c.isin("high", "low", "ok"), c)


def is_flagged(c: Column) -> Column:
    return c.isin("high", "low")


#: A table goes to all tasks only if its bytes, summed up, stay below this; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 24 << 20


def alias_table(aliases: DataFrame) -> tuple[DataFrame, bool]:
    """alias and targets, a map from provider to canonical: all targets of a name in one row, so that rows never fan out; and
    whether the table goes to all tasks. Of an alias that is listed twice for one provider the first target by code point counts.

    Observations are many and their names few, so by a shuffle on the name a few tasks would read most rows."""
    single = aliases.groupBy("alias", "alias_provider").agg(F.min("canonical").alias("canonical"))
    scoped = F.map_from_entries(F.collect_list(F.struct("alias_provider", "canonical")))
    table, fits = single.groupBy("alias").agg(scoped.alias("targets")), _fits(single)
    return (F.broadcast(table) if fits else table), fits


def _fits(single: DataFrame) -> bool:
    width = F.octet_length("alias") + F.octet_length("alias_provider") + F.octet_length("canonical") + 64
    return (single.agg(F.sum(F.coalesce(width, F.lit(64)))).first()[0] or 0) <= BROADCAST_BYTES


def measured(table: DataFrame, single: DataFrame) -> DataFrame:
    """table, to go to all tasks if the rows (alias, alias_provider, canonical) that it is made of are that small."""
    return F.broadcast(table) if _fits(single) else table


def _target(provider: Column) -> Column:
    return F.coalesce(F.element_at("targets", normalize_name(provider)), F.element_at("targets", F.lit("")))


def resolve(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `canonical`: the alias of the row's provider, else the global one, else null. rows: key, provider."""
    table, _ = alias_table(aliases)
    found = rows.join(table, rows["key"] == table["alias"], "left")
    return found.withColumn("canonical", _target(F.col("provider"))).drop("alias", "targets")


def enrich(
    metrics: DataFrame, reports: DataFrame, aliases: DataFrame, known: bool = False, among: Sequence[str] = (),
    described: Callable[[DataFrame], DataFrame] = lambda rows: rows, name: Column | None = None, dealt: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The enriched fact. known: only rows that have a canonical metric; among: only rows of these. Rows whose name leads to none
    of them, under no provider, go before they meet their reports.

    `described` makes the metrics' columns of narrower rows that have report_id and the given name, once these have met their
    reports, and the targets of a name come after that too if they go to all tasks: the shuffle carries neither. `dealt` says how
    the rows that are left are dealt to tasks by report_id, as what is grouped behind the reports is sorted in these tasks."""
    (table, fits), key = alias_table(aliases), normalize_name(F.col("name") if name is None else name)
    own = F.col("canonical").isin(*among) if among else F.col("canonical").isNotNull()
    if among:
        table = table.where(F.exists(F.map_values("targets"), lambda c: c.isin(*among)))
    some, rows = known or bool(among), metrics
    if not fits:
        rows = rows.join(table, key == F.col("alias"), "inner" if some else "left").drop("alias")
    elif some:
        rows = rows.join(table.select("alias"), key == F.col("alias"), "left_semi")
    found = described(dealt(rows).join(reports, "report_id")).withColumn("key", normalize_name(F.col("name")))
    if fits:
        found = found.join(table, F.col("key") == F.col("alias"), "left").drop("alias")
    found = found.withColumn("canonical", _target(F.col("provider"))).drop("targets")
    if some:
        found = found.where(own)
    found = found.withColumn("unit_key", canonical_unit(F.col("units")))
    return found.withColumn("grp", F.coalesce(F.concat(F.lit("canonical:"), "canonical"), F.concat(F.lit("raw:"), "key")))


def dominant(rows: DataFrame, by: list[str], value: str, order) -> DataFrame:
    """by and `dominant`: the most frequent value of each group, where null counts like any other; ties go to the value
    seen first in the given order. Pre-aggregated by value, so a group is never in one task."""
    votes = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "seen"))
    return votes.withColumn("place", best).where("place = 1").select(*by, F.col(value).alias("dominant"))


def dominants(rows: DataFrame, by: str, values: dict[str, bool], order: Column, *extra: tuple, weight: str | None = None) -> DataFrame:
    """by, the most frequent value of each column of `values`, the number n_<column> of its different values that aren't null,
    `n`, the rows, and the aggregates `extra` of rows that are grouped by `by` and value.

    All columns vote in one aggregation, so the rows are read once. A column whose entry is true counts null as a value; ties go
    to the value seen first. Columns are texts or doubles. An extra aggregate is a pair: a column over a group of equal values,
    and a function of the column of such groups. A row stands for as many as its column `weight` says, for one without it."""
    kinds = dict(rows.dtypes)

    def cell(i: int, c: str) -> Column:
        text = kinds[c] == "string"
        s, d = (F.col(c), F.lit(None).cast("double")) if text else (F.lit(None).cast("string"), F.col(c).cast("double"))
        return F.struct(F.lit(i).alias("i"), s.alias("s"), d.alias("d"))

    votes = rows.withColumn("_seen", order).withColumn("_vote", F.explode(F.array(*[cell(i, c) for i, c in enumerate(values)])))
    given = F.col("_vote.s").isNotNull() | F.col("_vote.d").isNotNull()
    counted = F.col("_vote.i").isin(*[i for i, nulls in enumerate(values.values()) if nulls]) if any(values.values()) else F.lit(False)
    inner = [a.alias(f"_extra{k}") for k, (a, _) in enumerate(extra)]
    votes = votes.groupBy(by, "_vote").agg((F.sum(weight) if weight else F.count("*")).alias("_n"), F.min("_seen").alias("_first"), *inner)
    own = lambda i: F.col("_vote.i") == i
    best = [F.min(F.when(own(i) & (given | counted), F.struct((-F.col("_n")).alias("n"), "_first", "_vote"))).alias(f"_best{i}") for i in range(len(values))]
    number = [F.count_if(own(i) & given).alias(f"n_{c}") for i, c in enumerate(values)]
    outer = [a(F.when(own(0), F.col(f"_extra{k}"))) for k, (_, a) in enumerate(extra)]
    out = votes.groupBy(by).agg(*best, *number, F.sum(F.when(own(0), F.col("_n"))).alias("n"), *outer)
    picked = [F.col(f"_best{i}._vote.{'s' if kinds[c] == 'string' else 'd'}").alias(c) for i, c in enumerate(values)]
    return out.select("*", *picked).drop(*[f"_best{i}" for i in range(len(values))])


def unit_votes(rows: DataFrame, order) -> DataFrame:
    """canonical, dominant unit key (null counts; ties go to the unit seen first) and the number of non-null units."""
    votes = rows.groupBy("canonical", "unit_key").agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "seen", "unit_key")).alias("best")
    return votes.groupBy("canonical").agg(best, F.count("unit_key").alias("n_units")).select("canonical", "n_units", F.col("best.unit_key").alias("dominant"))


def partition_units(rows: DataFrame, factors: DataFrame, order) -> DataFrame:
    """Adds `factor`, `display_unit`, `rescaled`, `low`, `high` and `excluded`; value, ref_low and ref_high stay as they were.

    A metric with a unit table keeps the units that it lists and rescales values and references. Any other metric with
    more than one unit keeps its dominant one, which may be null. rows: plottable ones of known metrics.
    """
    specs = F.broadcast(factors)  # a fixed table of a few rows per metric
    with_spec = F.broadcast(factors.select("canonical").distinct().withColumn("spec", F.lit(True)))
    joined = rows.join(specs, ["canonical", "unit_key"], "left").join(with_spec, "canonical", "left").join(unit_votes(rows, order), "canonical")
    by_vote = (F.col("n_units") > 1) & ~F.col("unit_key").eqNullSafe(F.col("dominant"))
    factor = F.coalesce("factor", F.lit(1.0))
    return joined.withColumn("excluded", F.when(F.col("spec"), F.col("factor").isNull()).otherwise(by_vote)).withColumns(
        {"rescaled": F.col("value") * factor, "low": F.col("ref_low") * factor, "high": F.col("ref_high") * factor}
    )


def unit_cells(rows: DataFrame, order) -> DataFrame:
    """canonical, unit_key, report_date and what the series need of such rows: their number, the first of them in order, and the
    newest row, least and greatest value. Rows of one unit are rescaled alike, so this comes before factors and votes, and the
    rows are read once. rows: plottable ones of known metrics."""
    newest_row = F.max_by(F.struct("value", "ref_low", "ref_high", "units", "provider", "report_id", "ord", "uploaded_at"), newest("value", "ref_low", "ref_high")).alias("k")
    return rows.groupBy("canonical", "unit_key", "report_date").agg(newest_row, F.count("*").alias("n"), F.min(order).alias("seen"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def cell_votes(cells: DataFrame) -> DataFrame:
    """What unit_votes gives, from the cells."""
    votes = cells.groupBy("canonical", "unit_key").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "seen", "unit_key")).alias("best")
    return votes.groupBy("canonical").agg(best, F.count("unit_key").alias("n_units")).select("canonical", "n_units", F.col("best.unit_key").alias("dominant"))


def partition_cells(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """The cells with `factor`, `display_unit` and `excluded`, as partition_units says of their rows."""
    specs = F.broadcast(factors)  # a fixed table of a few rows per metric
    with_spec = F.broadcast(factors.select("canonical").distinct().withColumn("spec", F.lit(True)))
    joined = cells.join(specs, ["canonical", "unit_key"], "left").join(with_spec, "canonical", "left").join(cell_votes(cells), "canonical")
    by_vote = (F.col("n_units") > 1) & ~F.col("unit_key").eqNullSafe(F.col("dominant"))
    return joined.withColumn("excluded", F.when(F.col("spec"), F.col("factor").isNull()).otherwise(by_vote))


def cell_points(cells: DataFrame) -> DataFrame:
    """What date_dedupe gives, from partitioned cells that aren't excluded."""
    factor = F.coalesce("factor", F.lit(1.0))
    scaled = cells.select("canonical", "report_date", "n", "display_unit", "k.units", "k.provider", "k.report_id", "k.ord", "k.uploaded_at", (F.col("k.value") * factor).alias("rescaled"),
                          (F.col("k.ref_low") * factor).alias("low"), (F.col("k.ref_high") * factor).alias("high"), (F.col("lo") * factor).alias("lo"), (F.col("hi") * factor).alias("hi"))
    kept = F.max_by(F.struct("rescaled", "low", "high", "units", "provider", "report_id", "ord", "display_unit"), newest()).alias("k")
    return _picked(scaled.groupBy("canonical", "report_date").agg(kept, F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


#: Numbers that a report_id can be.
IDS = Decimal(2**64)


def last_report() -> Column:
    """An aggregate that names a group's report of the newest upload, of several the one with the largest report_id: the time in
    microseconds, with room for any report_id behind it. It is a number, so groups are folded by hash."""
    at = F.col("uploaded_at")
    seconds = F.date_diff(at, F.to_date(F.lit("1970-01-01"))).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
    micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.max((micros.cast("decimal(18,0)") * F.lit(IDS) + F.col("report_id").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("last")


def last_report_id() -> Column:
    """The report_id of the report that last_report() names."""
    return (F.pmod(F.col("last") + F.lit(IDS / 2), F.lit(IDS)) - F.lit(IDS / 2)).cast("long")


def newest(value: str = "rescaled", low: str = "low", high: str = "high") -> Column:
    """Orders the rows of one metric and date: the newest upload first, then the order of rows, then the lower values."""
    row = F.struct(*[(-F.col(f"ord.{c}")).alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return F.struct(F.col("uploaded_at"), row, -F.col(value), -F.col(low), -F.col(high))


def date_dedupe(points: DataFrame) -> DataFrame:
    """The newest upload's point of each metric and date, with the number of others and whether they conflict."""
    kept = F.max_by(F.struct("rescaled", "low", "high", "units", "provider", "report_id", "ord", "display_unit"), newest()).alias("k")
    return _picked(points.groupBy("canonical", "report_date").agg(kept, F.count("*").alias("n"), F.min("rescaled").alias("lo"), F.max("rescaled").alias("hi")))


def _picked(picked: DataFrame) -> DataFrame:
    return picked.select("canonical", "report_date", F.col("k.rescaled").alias("value"), "k.low", "k.high", "k.units", "k.provider", "k.report_id", "k.ord",
                         "k.display_unit", (F.col("n") - 1).alias("others"), (F.col("lo") < F.col("hi")).alias("conflict"))


def clashing(cells: DataFrame) -> DataFrame:
    """canonical, unit_key, report_date and factor of the partitioned cells whose metric has different values on their date."""
    factor = F.coalesce("factor", F.lit(1.0))
    own = cells.select("canonical", "unit_key", "report_date", factor.alias("factor"), (F.col("lo") * factor).alias("lo"), (F.col("hi") * factor).alias("hi"))
    dates = own.groupBy("canonical", "report_date").agg((F.min("lo") < F.max("hi")).alias("clash")).where("clash").select("canonical", "report_date")
    return own.select("canonical", "unit_key", "report_date", "factor").join(dates, ["canonical", "report_date"])


def of_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of the cells (canonical, unit_key, report_date, factor), rescaled."""
    cells = cells.select(F.col("canonical").alias("_metric"), F.col("unit_key").alias("_unit"), F.col("report_date").alias("_date"), "factor")
    same = (F.col("canonical") == F.col("_metric")) & F.col("unit_key").eqNullSafe(F.col("_unit")) & (F.col("report_date") == F.col("_date"))
    few = F.broadcast(cells) if cells.count() * 128 <= BROADCAST_BYTES else cells
    return rows.join(few, same).withColumns({"rescaled": F.col("value") * F.col("factor"), "low": F.col("ref_low") * F.col("factor"), "high": F.col("ref_high") * F.col("factor")})


def discarded(points: DataFrame) -> DataFrame:
    """canonical, report_date and each row that a newer upload of another value displaced, with its place from 1."""
    clash = points.groupBy("canonical", "report_date").agg((F.min("rescaled") < F.max("rescaled")).alias("clash")).where("clash").drop("clash")
    return displaced(points.join(clash, ["canonical", "report_date"]))


def displaced(rows: DataFrame) -> DataFrame:
    """The same from the rows of such dates only."""
    place = F.row_number().over(W.partitionBy("canonical", "report_date").orderBy(F.desc(newest())))
    return rows.withColumn("place", place - 1).where("place > 0").select("canonical", "report_date", "place", F.col("rescaled").alias("value"), "report_id", "provider", "uploaded_at")
