"""Measurement model over the driver's tables: reports, metrics, canonical metrics, aliases and unit factors.

MODEL_SQL states the same views for DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical metric, category, tags.
CANONICALS = [
    ("ring", "cbc", "cardio-risk,longevity"), ("bolt", "lipids", "cardio-risk"), ("gear", "cbc", ""), ("rod", "hormones", "longevity"),
    ("widget", "lipids", ""), ("gizmo", "other", ""), ("plate", "other", ""), ("anvil", "hormones", "cardio-risk"),
]
#: Metric, unit key, factor to the display unit.
FACTORS = [(m, u, f, "k/µL") for m in ("ring", "bolt", "gear", "rod") for u, f in (("k/ul", 1.0), ("cells/ul", 0.001))]
UNITS = ("cells/uL", "k/µL", "x10E3/uL", "Thousand/uL", "%")
ORD = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.lower("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("report_category"),
        F.to_date("o_orderdate").alias("report_date"), F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 90 as int))").alias("uploaded_at"),
    )


#: What a line has besides the columns of its part and its report that a query names.
LINE = "report_id", *ORD[1:], "l_quantity", "l_tax", "l_discount", "l_returnflag", "p_name"


def lines(spark: SparkSession, sf_dir: str, *of_part: str) -> DataFrame:
    """Observations as the tables have them, with the name and the named columns of their part: few bytes a row, so joins come
    before `described` makes names, units and structs of them."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name", *of_part)
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "report_id").select(*LINE, *of_part)


#: Lines that a task gets by a shuffle, where the session's number of partitions would give it more.
TASK_LINES = 500_000


def dealt(rows: DataFrame, lines: DataFrame, *by: str) -> DataFrame:
    """rows, no more than the table `lines` has, dealt by their keys to so many tasks that the memory of one doesn't grow with
    the table; unchanged while the session's own partitions are that small. Counting a table reads its footers only."""
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = math.ceil(lines.count() / TASK_LINES)
    return rows.repartition(n, *by) if n > own else rows


def line_name() -> Column:
    """The name of a line's observation."""
    n = F.col("l_linenumber")
    return F.when(n % 3 == 0, F.upper("p_name")).when(n % 3 == 1, F.concat(F.lit("  "), "p_name")).otherwise(F.col("p_name"))


def described(lines: DataFrame) -> DataFrame:
    """One row per observation, from its line; columns that aren't the line's stay. `ord` orders rows where nothing else does."""
    text = F.col("l_linenumber") == 7
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS], F.lit(None)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return lines.select(
        F.struct(F.col("report_id").alias(ORD[0]), *ORD[1:]).alias("ord"), "report_id", line_name().alias("name"),
        F.when(~text, F.col("l_quantity")).alias("value"), F.when(text, "<dl").alias("value_text"), unit.alias("units"),
        F.col("l_tax").alias("ref_low"), F.col("l_discount").alias("ref_high"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "low").otherwise("ok").alias("flag"),
        *[c for c in lines.columns if c not in LINE],
    )


def metrics(spark: SparkSession, sf_dir: str, *of_part: str) -> DataFrame:
    """One row per observation, with the named columns of its part."""
    return described(lines(spark, sf_dir, *of_part))


def canonicals(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CANONICALS, "canonical string, category string, tags string")
    return rows.withColumn("tags", F.filter(F.split("tags", ","), lambda t: t != ""))


def factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTORS, "canonical string, unit_key string, factor double, display_unit string")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts whose adjective isn't `cold`; those of `old` parts have another target for one provider."""
    known = F.broadcast(canonicals(spark).select("canonical"))
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    word = F.split("p_name", " ")
    every = names.select(F.lower("p_name").alias("alias"), word[0].alias("adj"), word[1].alias("canonical")).where("adj <> 'cold'").join(known, "canonical")
    scoped = every.where("adj = 'old'").select("alias", F.lit("1-urgent").alias("alias_provider"), F.lit("gear").alias("canonical"))
    return every.select("alias", F.lit("").alias("alias_provider"), "canonical").union(scoped)


def _values(rows, names):
    cell = lambda x: str(x) if isinstance(x, float) else "'" + x + "'"
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({names})"


MODEL_SQL = f"""
with reports as (select o_orderkey as report_id, lower(o_orderpriority) as provider, o_orderstatus as report_category,
  cast(o_orderdate as date) as report_date, o_orderdate + to_days(cast(o_orderkey % 90 as integer)) as uploaded_at from orders),
metrics as (select (l_orderkey, l_linenumber, l_partkey, l_suppkey) as ord, l_orderkey as report_id,
  case l_linenumber % 3 when 0 then upper(p_name) when 1 then '  ' || p_name else p_name end as name,
  case when l_linenumber <> 7 then l_quantity end as value, case when l_linenumber = 7 then '<dl' end as value_text,
  case l_suppkey % 6 {' '.join(f"when {i} then '{u}'" for i, u in enumerate(UNITS))} end as units, l_tax as ref_low, l_discount as ref_high,
  case l_returnflag when 'R' then 'high' when 'A' then 'low' else 'ok' end as flag from lineitem join part on l_partkey = p_partkey),
canonicals as (select canonical, category, list_filter(string_split(tags, ','), lambda x: x <> '') as tags from {_values(CANONICALS, 'canonical, category, tags')}),
factors as (select * from {_values(FACTORS, 'canonical, unit_key, factor, display_unit')}),
named as (select distinct lower(p_name) as alias, split_part(p_name, ' ', 1) as adj, split_part(p_name, ' ', 2) as canonical from part),
every as (select named.* from named join canonicals using (canonical) where adj <> 'cold'),
aliases as (select alias, '' as alias_provider, canonical from every union all select alias, '1-urgent', 'gear' from every where adj = 'old'),
fact as (select m.*, r.provider, r.report_category, r.report_date, r.uploaded_at, lower(trim(m.name)) as key, coalesce(s.canonical, g.canonical) as canonical,
  case lower(replace(m.units, 'µ', 'u')) when 'x10e3/ul' then 'k/ul' when 'thousand/ul' then 'k/ul' else lower(replace(m.units, 'µ', 'u')) end as unit_key,
  case when coalesce(s.canonical, g.canonical) is not null then 'canonical:' || coalesce(s.canonical, g.canonical) else 'raw:' || lower(trim(m.name)) end as grp
  from metrics m join reports r using (report_id)
  left join aliases s on s.alias = lower(trim(m.name)) and s.alias_provider = r.provider
  left join aliases g on g.alias = lower(trim(m.name)) and g.alias_provider = '')
"""
