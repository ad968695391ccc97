"""Numbering rows of a table in a global order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of the key whose values make up the ranges that are numbered apart.
PREFIX = 3


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `place`, 1 for the least key (a string). Ranges are the key's first characters: their sizes are summed
    up over a table of one row per range, and rows are numbered inside their range."""
    own = F.coalesce(F.substring(key, 1, PREFIX), F.lit(""))
    ranged = rows.withColumn("_range", own)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(W.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_local", local).join(before, "_range").withColumn("place", F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")
