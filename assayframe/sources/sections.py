"""Text files of stacked sections: a head, then rows in their order, sections apart by a blank line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stacked(spark: SparkSession, sections: list[tuple[str, DataFrame, list]]) -> DataFrame:
    """section, nth and line of (head, rows with a column `line`, columns to sort by). Each section is sorted by ranges and its
    places are taken from the partitions' order, so no task has all rows of one."""
    out = None
    for i, (head, rows, order) in enumerate(sections):
        first = ([(-2, "")] if i else []) + [(-1, head)]
        lines = spark.createDataFrame(first, "nth long, line string").unionByName(rows.orderBy(*order).select(F.monotonically_increasing_id().alias("nth"), "line"))
        lines = lines.withColumn("section", F.lit(i))
        out = lines if out is None else out.unionByName(lines)
    return out.select("section", "nth", "line")


def write_sections(spark: SparkSession, path: str, sections: list[tuple[str, DataFrame, list]]) -> None:
    """Writes the lines to text files whose order by name is the order of the whole; a line ends with a line feed.

    Edge cases: a section without rows has its head alone; a null line is an empty one; line feeds inside a quoted cell stay."""
    lines = stacked(spark, sections).withColumn("line", F.coalesce("line", F.lit("")))
    lines.repartitionByRange("section", "nth").sortWithinPartitions("section", "nth").select("line").write.mode("overwrite").text(path)
