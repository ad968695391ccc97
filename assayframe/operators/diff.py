"""Compares two extractions of the same reports: first by panel and name, then what is left by name alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 0.05


def plain_name(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces; a final `spp.` is `spp`."""
    low = F.regexp_replace(F.lower(c), r"\s+spp\.?\s*$", " spp")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9 ]", " "), r"\s+", " "))


def _keyed(rows: DataFrame, side: str) -> DataFrame:
    """report_id, key, side and the cells of each row. rows: report_id, panel, name, value, value_text, unit, ord."""
    name, panel = plain_name(F.col("name")), plain_name(F.col("panel"))
    key = F.when(F.coalesce("panel", F.lit("")) != "", F.concat(panel, F.lit("::"), name)).otherwise(name)
    return rows.select("report_id", key.alias("key"), F.lit(side).alias("side"), F.struct("ord", name.alias("name"), "value", "value_text", "unit").alias("x"))


def values_equal(x: Column, y: Column, x_text: Column, y_text: Column) -> Column:
    """Two texts are compared without case, a text never equals a bare number, and numbers may be TOLERANCE of the larger apart."""
    s, t = F.lower(F.nullif(x_text, F.lit(""))), F.lower(F.nullif(y_text, F.lit("")))
    near = F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y))
    numbers = F.when(x.isNull() & y.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))
    return F.when(s.isNotNull() | t.isNotNull(), F.coalesce(s == t, F.lit(False))).otherwise(numbers)


def units_equal(x: Column, y: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    return bare(x) == bare(y)


def _bucket(a: str, b: str) -> Column:
    side = lambda s: [F.col(f"{s}.{c}") for c in ("value", "value_text", "unit")]
    (x, xt, xu), (y, yt, yu) = side(a), side(b)
    return F.when(~units_equal(xu, yu), "units").when(~values_equal(x, y, xt, yt), "value").otherwise("matched")


def extract_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """report_id, name and bucket (matched, value, units, left, right) of every keyed row of both sides.

    Both sides are stacked and grouped by report and key, so either is read once, and a group with both has met. What is
    left meets by name: the last row of the left stands for its name, and the first one of the right takes it; other rows of
    that name are found on one side only. A report's rows of one name are a window."""
    stacked = _keyed(left, "a").union(_keyed(right, "b"))
    first = lambda s: F.min_by("x", F.when(F.col("side") == s, F.col("x.ord"))).alias(s)
    rows = stacked.groupBy("report_id", "key").agg(first("a"), first("b")).withColumn("name", F.coalesce("a.name", "b.name"))
    only_a, only_b = F.col("b").isNull(), F.col("a").isNull()
    name = W.partitionBy("report_id", "name")
    last_a = F.row_number().over(name.orderBy(only_a.desc(), F.desc("a.ord"), "key")) == 1
    first_b = F.row_number().over(name.orderBy(only_b.desc(), "b.ord", "key")) == 1
    rows = rows.withColumns({"asks": only_a & last_a, "takes": only_b & first_b})
    rows = rows.withColumns({"asked": F.bool_or("asks").over(name), "taken": F.max(F.when(F.col("takes"), F.col("b"))).over(name)})
    pairs = rows.where(~(F.col("takes") & F.col("asked"))).withColumn("b", F.when(F.col("asks"), F.col("taken")).otherwise(F.col("b")))
    bucket = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise(_bucket("a", "b"))
    return pairs.select("report_id", "name", bucket.alias("bucket"))
