"""A registry of parsers: a test as a column says whose format a text has, and a parser reads it.

The first parser whose test holds reads a text; no other is tried after it. A parser is a function of one text, run in
Arrow batches, or a function of a table of texts. A text that its parser fails on, or that gives fewer rows than the parser
must find, has no rows but the error, and the job goes on.

Edge cases: a null text fits no parser; a text without a parser has no error either; report_ids that repeat are read each
by itself in a function of one text, and together in a function of a table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import reports as rp
from assayframe.operators import printed
from assayframe.sources.scratch import work_folder, written

#: What a parser finds, a row each.
ROW = "name string, panel string, numeric double, text string, units string, low double, high double, ref_text string, flag string"
COLUMNS = [c.split(" ")[0] for c in ROW.split(", ")]


@dataclass(frozen=True)
class Parser:
    """name and version; detect: a text column to whether it has the format. Either `one` reads a text to dicts of ROW, or
    `table` reads (report_id, text) to report_id, nth and ROW; least: rows that a text must give."""

    name: str
    version: int
    detect: Callable[[Column], Column]
    one: Callable[[str], list[dict]] | None = None
    table: Callable[[DataFrame], DataFrame] | None = None
    least: int = 0


def panel_report(least: int = 30) -> Parser:
    return Parser("panel-report", 1, rp.is_report, table=printed.read_texts, least=least)


def json_report() -> Parser:
    """Answers in JSON with a list `metrics`, also cut off ones."""

    def read(texts: DataFrame) -> DataFrame:
        fields = {"name": "name", "panel": "panel", "numeric": "valueNumeric", "text": "valueText", "units": "units", "low": "refLow", "high": "refHigh", "ref_text": "refText", "flag": "flag"}
        kinds = dict(c.split(" ") for c in ROW.split(", "))
        items = texts.select("report_id", F.posexplode(F.try_variant_get(rp.answer(F.col("text")), "$.metrics", "array<variant>")).alias("nth", "v"))
        return items.select("report_id", F.col("nth").cast("long").alias("nth"), *[F.try_variant_get("v", f"$.{f}", kinds[c]).alias(c) for c, f in fields.items()])

    return Parser("json", 1, lambda text: F.coalesce(text.contains('"metrics"'), F.lit(False)), table=read)


REGISTRY: list[Parser] = [panel_report(), json_report()]


def register(parser: Parser, registry: list[Parser] = REGISTRY) -> None:
    """Adds a parser behind the others; a name stands for one parser."""
    if any(p.name == parser.name for p in registry):
        raise ValueError(f"{parser.name} is registered")
    if (parser.one is None) == (parser.table is None):
        raise ValueError(f"{parser.name} needs a function of a text or of a table")
    registry.append(parser)


def chosen(text: Column, registry: list[Parser]) -> Column:
    """The name of the first parser whose format a text has."""
    return F.coalesce(*[F.when(p.detect(text), F.lit(p.name)) for p in registry], F.lit(None).cast("string"))


def _each(texts: DataFrame, parser: Parser) -> DataFrame:
    """report_id, error and items of each text; an exception is the text's error."""
    kind = dict(texts.dtypes)["report_id"]
    read, fields = parser.one, ["nth", *COLUMNS]
    item = pa.struct([("nth", pa.int64()), *[(c, pa.float64() if c in ("numeric", "low", "high") else pa.string()) for c in COLUMNS]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, found = [], []
            for text in batch.column(1).to_pylist():
                try:
                    rows = pa.array([{"nth": i, **{c: r.get(c) for c in COLUMNS}} for i, r in enumerate(read(text))], item).to_pylist()
                    errors.append(None)
                except Exception as e:  # whatever a parser raises is that text's error
                    rows = []
                    errors.append(f"{type(e).__name__}: {e}")
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(found, pa.list_(item))], names=["report_id", "error", "items"])

    return texts.select("report_id", "text").mapInArrow(run, f"report_id {kind}, error string, items array<struct<{', '.join(f'{c}: {k}' for c, k in zip(fields, ['long', *[x.split(' ')[1] for x in ROW.split(', ')]], strict=True))}>>")


def parse(texts: DataFrame, registry: list[Parser] = REGISTRY, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (report_id, nth and ROW) and the outcomes (report_id, parser, version, n_rows, error) of (report_id, text).

    parser is null where none fits or the one that fits failed. Texts are made and told apart once, and read once: those that a
    parser fits and what it finds are written to `folder`, from which both results are read; who names it may delete it behind
    them, else it is a work folder."""
    folder = folder or work_folder(texts.sparkSession, "parsed")
    named = texts.select("report_id", "text", chosen(F.col("text"), registry).alias("parser"))
    named = written(named.select("report_id", F.when(F.col("parser").isNotNull(), F.col("text")).alias("text"), "parser"), "texts", f"{folder}/texts")
    rows, told = None, named.where("parser is null").select("report_id", *[F.lit(None).cast(k).alias(c) for c, k in (("parser", "string"), ("version", "int"))], F.lit(0).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("error"))
    for i, p in enumerate(registry):
        own = named.where(F.col("parser") == p.name)
        found = _each(own, p) if p.one else p.table(own.select("report_id", "text")).select("report_id", "nth", *COLUMNS)
        found = written(found, "found", f"{folder}/found-{i}")
        if p.one:
            counts = found.select("report_id", "error", F.size("items").cast("long").alias("n_rows"))
            found = found.select("report_id", F.explode("items").alias("x")).select("report_id", "x.nth", *[f"x.{c}" for c in COLUMNS])
        else:
            counts = own.select("report_id").join(found.groupBy("report_id").agg(F.count("*").alias("n_rows")), "report_id", "left")
            counts = counts.select("report_id", F.lit(None).cast("string").alias("error"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        few = F.concat(F.lit("only "), F.col("n_rows").cast("string"), F.lit(f" rows, at least {p.least} expected"))
        counts = counts.withColumn("error", F.coalesce("error", F.when(F.col("n_rows") < p.least, few)))
        fine = F.col("error").isNull()
        told = told.unionByName(counts.select("report_id", F.when(fine, p.name).alias("parser"), F.when(fine, p.version).alias("version"), F.when(fine, F.col("n_rows")).otherwise(0).alias("n_rows"), "error"))
        if p.least:
            found = found.join(counts.where(fine).select("report_id"), "report_id", "left_semi")
        rows = found if rows is None else rows.unionByName(found)
    return rows, told
