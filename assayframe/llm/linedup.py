"""Operator 8: repeated runs of lines by a suffix order over line ids, with distributed prefix doubling and built-in functions only.

The corpus is one sequence of lines: documents are sorted by ranges of their id, and a line's place is its number in that
order. A suffix is a place; only suffixes whose first line repeats are sorted, as no other can begin a repeated run. Level k
holds the suffixes whose first 2 ** k lines occur elsewhere too and ranks them by these lines: the pairs of ranks of a suffix
and of the one 2 ** (k - 1) lines on are grouped, those that occur twice are sorted by ranges, and their numbers in that
order are the new ranks. So equal ranks are the intervals of suffixes with a common prefix of 2 ** k lines, in suffix order,
and levels go on until none has two suffixes: log2 of the longest repeated run. A document is where suffixes end.

The first suffix of an interval, by place, stays; each later one marks the lines of the common prefix. A maximal run of any
length is the union of its marks, as its last 2 ** k lines are marked by a suffix inside it. Runs shorter than `run` lines stay.
Stretches of marked lines are deleted from their first line that isn't blank to their last; blank lines alone stay.

Edge cases: a null text has no lines, an empty one a single blank line; rows that repeat an earlier row's doc_id and text are
answered like it; a null doc_id counts as above all others; very long texts are sorted by their lines like others, and what
is deleted is joined to them as ranges; other columns are not read; an empty table has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm.shared import cut, measured_broadcast

#: Least lines of a repeated run.
RUN = 1
LAST = 2**63 - 1
SOLID = r"[^\x20\x09-\x0D]"


def line_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """place, at (in the document, from 0), left (lines from there to its end) and names a, b of each line; and the documents
    (id, row) with the place of their first line. docs: id, row, text."""
    names = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b")))
    ordered = docs.where("text is not null").select("id", "row", names.alias("ls")).repartitionByRange("id", "row").dropDuplicates(["id", "row"])
    ordered = ordered.sortWithinPartitions("id", "row").select("id", "row", F.size("ls").alias("n"), F.posexplode("ls").alias("at", "l"))
    lines = cut(ordered.select(F.monotonically_increasing_id().alias("place"), "at", (F.col("n") - F.col("at")).alias("left"), "l.a", "l.b", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("id", "row")]), "line-places")
    return lines.drop("id", "row"), lines.where("at = 0").select("id", "row", F.col("place").alias("head"))


def ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """place, left, rank and first (the interval's first place) of the suffixes that share `keys` with another one.

    Ranks are numbers in the order of the keys: intervals are counted first, sorted by ranges and numbered by partition."""
    kinds = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    kinds = cut(kinds.orderBy(*keys).select(*keys, "first", F.monotonically_increasing_id().alias("rank")), "line-intervals")
    return cut(suffixes.join(kinds, keys).select("place", "at", "left", "rank", "first"), "line-ranks")


def joined(level: DataFrame, lines: int) -> DataFrame:
    """Suffixes of a level with the rank r2 of the suffix `lines` further on in the same document, where that is in the level."""
    ahead = level.select((F.col("place") - lines).alias("place"), F.col("rank").alias("r2"))
    return level.where(F.col("left") > lines).select("place", "at", "left", F.col("rank").alias("r1")).join(ahead, "place")


def levels(lines: DataFrame):
    """(h, suffixes whose first h lines repeat) for h of 1, 2, 4, ... while there are any."""
    h, level = 1, ranked(lines, ["a", "b"])
    while level.limit(1).count():
        yield h, level
        level, h = ranked(joined(level, h), ["r1", "r2"]), 2 * h


def later_marks(lines: DataFrame, run: int) -> DataFrame:
    """head (the document's first place), start and stop of the lines that a later suffix shares with an earlier one."""
    marks = None
    last = 1 << run.bit_length() - 1
    for h, level in levels(lines):
        if h < last:
            continue
        kept = level if h > run or h == run else ranked(joined(level, run - h), ["r1", "r2"])
        size = max(h, run)
        found = kept.where("first < place").select((F.col("place") - F.col("at")).alias("head"), F.col("at").alias("start"), (F.col("at") + size).alias("stop"))
        marks = found if marks is None else marks.union(found)
    if marks is None:
        return lines.select(F.col("place").alias("head"), F.col("at").alias("start"), F.col("at").alias("stop")).limit(0)
    return marks.groupBy("head", "start").agg(F.max("stop").alias("stop"))


def stretches(marks: DataFrame) -> DataFrame:
    """head, start and stop of the maximal stretches of marked lines."""
    order = W.partitionBy("head").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # one document's marks
    opened = marks.withColumn("fresh", F.coalesce((F.col("start") > F.max("stop").over(order)).cast("int"), F.lit(1)))
    nth = F.sum("fresh").over(W.partitionBy("head").orderBy("start"))
    return opened.withColumn("nth", nth).groupBy("head", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("nth")


def trimmed(ls: Column, gaps: Column) -> Column:
    """Stretches from their first line that isn't blank to their last; those of blank lines go."""
    def ends(g: Column) -> Column:
        solid = F.transform(F.slice(ls, g["start"] + 1, g["stop"] - g["start"]), lambda x: x.rlike(SOLID))
        before, behind = F.array_position(solid, True), F.array_position(F.reverse(solid), True)
        return F.when(before > 0, F.struct((g["start"] + before - 1).cast("int").alias("start"), (g["stop"] - behind + 1).cast("int").alias("stop")))

    return F.array_compact(F.transform(gaps, ends))


def remove_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs (deleted stretches) and kept_text of every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("row"), "text")
    lines, heads = line_places(rows)
    found = stretches(later_marks(lines, run)).groupBy("head").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gaps"))
    lists = cut(found.join(heads, "head").select("id", "row", "gaps"), "line-gaps")
    text_lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    out = rows.join(measured_broadcast(lists, 16 * F.size("gaps"), 100), ["id", "row"], "left").withColumn("ls", text_lines)
    out = out.withColumn("gone", F.coalesce(trimmed(F.col("ls"), F.col("gaps")), F.array().cast("array<struct<start:int,stop:int>>")))
    n = F.size("gone")
    since = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["stop"]))
    until = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("ls")))
    kept = F.flatten(F.transform(F.arrays_zip(since.alias("a"), until.alias("z")), lambda g: F.slice(F.col("ls"), g["a"] + 1, g["z"] - g["a"])))
    return out.select(
        F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), F.size("ls").cast("long").alias("n_lines"),
        F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["stop"] - g["start"]).alias("n_removed"), n.cast("long").alias("n_runs"),
        F.when(n == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# From one line on, what earlier runs have is what earlier lines are: marked lines, then stretches of them without blank ends.
OP8_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, i, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
m as (select *, row_number() over (partition by line order by doc_id nulls last, i) > 1 as marked, regexp_matches(line, '[^\x20\x09-\x0D]') as solid from l),
s as (select *, i - row_number() over (partition by doc_id order by i) as stretch from m where marked),
e as (select doc_id, stretch, min(i) filter (where solid) as a, max(i) filter (where solid) as z from s group by doc_id, stretch having count(*) filter (where solid) > 0),
k as (select l.doc_id, l.i, l.line from l where not exists (select 1 from e where e.doc_id = l.doc_id and l.i between e.a and e.z)),
t as (select doc_id, string_agg(line, chr(10) order by i) as kept_text from k group by doc_id),
g as (select doc_id, sum(z - a + 1) as n, count(*) as runs from e group by doc_id)
select d.doc_id, cast(coalesce(len(d.ls), 0) as bigint) as n_lines, cast(coalesce(g.n, 0) as bigint) as n_removed, cast(coalesce(g.runs, 0) as bigint) as n_runs, sha256(coalesce(t.kept_text, '')) as kept_sha256
from d left join t on d.doc_id = t.doc_id left join g on d.doc_id = g.doc_id
"""
