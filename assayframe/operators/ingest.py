"""What the rows of a report become when it is stored: equal rows once, folded in their order, panels and metrics resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.functions.text import canonical_unit, normalize_name
from assayframe.operators import facts


def folded(rows: DataFrame, by: list[str], order: str, name: str, units: str, value: str, text: str, low: str, high: str, flag: str) -> DataFrame:
    """One row for each of `by`, name, unit, value and text: the first in order, whose missing references and flag come from the
    first later row that has them; `dropped` other rows, and `disagreed`, the references that differ from the kept ones.

    Names and texts are compared trimmed and in lower case, units by their canonical key. One shuffle deals the rows to their
    group, where a running first value takes the place of a fold.

    Edge cases: null units, values and texts equal each other (a null text an empty one); an empty flag is none; rows of equal
    order are taken in the order of their references; no rows give no rows.
    """
    keys = {"_name": normalize_name(F.col(name)), "_unit": F.coalesce(canonical_unit(F.col(units)), F.lit("")), "_value": F.col(value), "_text": normalize_name(F.col(text))}
    group = [*by, *keys]
    so_far = W.partitionBy(*group).orderBy(order, low, high).rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumns(keys)
    differs = lambda c: F.coalesce((F.col(c) != F.first(c, ignorenulls=True).over(so_far)).cast("long"), F.lit(0))
    seen = seen.withColumn("_differs", differs(low) + differs(high))
    kept = [c for c in rows.columns if c not in (*by, low, high, flag)]
    once = lambda c, given: F.min_by(c, F.when(given, F.struct(order, low, high))).alias(c)
    out = seen.groupBy(*group).agg(
        F.min_by(F.struct(*kept), F.struct(order, low, high)).alias("_kept"), once(low, F.col(low).isNotNull()), once(high, F.col(high).isNotNull()),
        once(flag, F.coalesce(F.col(flag) != "", F.lit(False))), (F.count("*") - 1).alias("dropped"), F.sum("_differs").alias("disagreed"),
    )
    return out.select(*by, "_kept.*", low, high, flag, "dropped", "disagreed")


def panel_id() -> Column:
    """The number of a row's panel in its report; null without one."""
    return F.when(F.col("panel") != "", F.xxhash64("report_id", "panel"))


def panels_of(rows: DataFrame) -> DataFrame:
    """report_id, panel_id, name and nth of each report's panels, as first seen. rows: report_id, nth, panel."""
    seen = rows.where("panel is not null and panel <> ''").groupBy("report_id", "panel").agg(F.min("nth").alias("seen"))
    nth = F.row_number().over(W.partitionBy("report_id").orderBy("seen", "panel"))  # one report's panels
    return seen.select("report_id", panel_id().alias("panel_id"), F.col("panel").alias("name"), nth.cast("long").alias("nth"))


def resolved(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (with name and provider) and `canonical`, by the provider's alias or the global one."""
    return facts.resolve(rows.withColumn("key", normalize_name(F.col("name"))), aliases).drop("key")
