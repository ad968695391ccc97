"""Reports kept as parquet: several tables written batch by batch, and a batch counts from its commit on.

A batch writes its rows of each table below `table/batch=name`, over whatever an attempt that failed has left there, and
then a row in `commits`. Readers take committed batches only, so they see all tables of a batch or none, and a batch that
is committed isn't written again. A report's current rows are those of its last batch: a replay or a new mapping writes
the reports it touches anew and leaves the others where they are. All work is joins on report_id, hash or name; what comes
to the driver is a name and a number a batch.

One writer at a time gives batches their numbers; readers need no lock. Names of batches are letters, digits, `-`, `_`.

Edge cases: a null file_hash is no report; of a hash that repeats in a batch the first path stays, and one that is stored
already is left out; a report without rows has no panels and metrics; rows of unknown reports are left out; an extraction
that can't be read leaves its report as it is; an empty store reads as empty tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.functions import reports as rp
from assayframe.functions.text import normalize_name
from assayframe.operators import facts, ingest, parsers
from assayframe.sources.scratch import COMPRESSION, tidily, work_folder, written  # noqa: F401

ITEM = "name string, panel string, value double, value_text string, units string, ref_low double, ref_high double, ref_text string, flag string"
HEADERS = "file_path string, file_hash string, provider string, category string, report_date date, model string, extractor_kind string, extractor_version int, raw string"
SCHEMAS = {
    "reports": "report_id long, file_path string, file_hash string, provider string, category string, report_date date",
    "extractions": "report_id long, extraction_id long, model string, extractor_kind string, extractor_version int, metric_count long, raw string",
    "panels": "report_id long, panel_id long, name string, nth long",
    "metrics": "report_id long, nth long, panel_id long, canonical string, " + ITEM,
    "aliases": "alias string, alias_provider string, canonical string",
}


def columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class ReportStore:
    """The tables of SCHEMAS below one folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, table: str, schema: str) -> DataFrame:
        path, full = f"{self.root}/{table}", f"{schema}, batch string"
        return self.spark.read.schema(full).parquet(path) if self._there(path) else self.spark.createDataFrame([], full)

    def commits(self) -> DataFrame:
        """batch and seq of what is committed, a row each."""
        return self._read("commits", "seq long")

    def every(self, table: str) -> DataFrame:
        """All committed rows of a table, with batch and seq."""
        commits = self.commits()
        names = [r[0] for r in commits.select("batch").collect()]
        # Only committed folders are scanned: files of an attempt that failed may go while this is read.
        return self._read(table, SCHEMAS[table]).where(F.col("batch").isin(names)).join(commits, "batch")

    def current(self, table: str) -> DataFrame:
        """The rows that hold: of each report those of its last batch, every extraction, and the last list of aliases."""
        rows = self.every(table)
        if table == "extractions":
            return rows.drop("batch")
        if table == "aliases":
            last = rows.agg(F.max("seq").alias("seq"))
            return rows.join(last, "seq").select(*columns(SCHEMAS[table]))
        last = self.every("reports").groupBy("report_id").agg(F.max("seq").alias("last"))
        # No row is of a later batch than its report. Dealt by report_id alone, rows needn't be dealt again to be grouped by it.
        return rows.join(last, "report_id").where("seq >= last").select(*columns(SCHEMAS[table]))

    def _open(self, batch: str) -> int | None:
        """The number that a batch will have; null if it is committed."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"no name of a batch: {batch}")
        done = self.commits().agg(F.max("seq"), F.count_if(F.col("batch") == batch)).first()
        return None if done[1] else (done[0] or 0) + 1

    def write(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Writes the tables and commits; False, and nothing done, if the batch is committed."""
        seq = self._open(batch)
        if seq is None:
            return False
        for name, rows in tables.items():
            self._write_table(name, batch, rows.select(*columns(SCHEMAS[name])))
        self.spark.createDataFrame([(seq,)], "seq long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")
        return True

    def _write_table(self, name: str, batch: str, rows: DataFrame) -> None:
        with tidily(self.spark):
            rows.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{self.root}/{name}/batch={batch}")

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @contextmanager
    def staged(self) -> Iterator[str]:
        """A folder for steps of a batch, deleted behind it."""
        folder = f"{self.root}/staged-{uuid.uuid4().hex}"
        try:
            yield folder
        finally:
            self._drop(folder)

    def ingest(self, batch: str, headers: DataFrame, rows: DataFrame) -> bool:
        """Stores new reports: headers (HEADERS), one a file; rows (file_hash, nth and ITEM), equal ones folded into one."""
        known = self.every("reports").select("file_hash").distinct()
        least = F.min_by(F.struct(*[c for c in columns(HEADERS) if c != "file_hash"]), F.struct("file_path", "raw")).alias("h")
        new = headers.where("file_hash is not null").join(known, "file_hash", "left_anti").groupBy("file_hash").agg(least).select("file_hash", "h.*")
        new = new.withColumn("report_id", F.xxhash64("file_hash"))
        # Rows are dealt once, by their report's number: that a file's hash gives it is what the whole store relies on.
        own = rows.where("file_hash is not null").withColumn("report_id", F.xxhash64("file_hash")).drop("file_hash")

        def once(heads: DataFrame) -> DataFrame:
            return ingest.folded(own.join(heads, "report_id"), ["report_id"], "nth", "name", "units", "value", "value_text", "ref_low", "ref_high", "flag")

        return self._store(batch, new, once)

    def replace(self, batch: str, headers: DataFrame, rows: DataFrame) -> bool:
        """Stores another reading of reports that are there: headers (report_id and HEADERS but path and hash), one a report;
        rows (report_id, nth and ITEM) as they are. Each gets an extraction more."""
        held = self.current("reports").select("report_id", "file_path", "file_hash")
        return self._store(batch, headers.join(held, "report_id"), lambda heads: rows.join(heads, "report_id"))

    def replay(self, batch: str, report_ids: DataFrame) -> bool:
        """Reads the last extraction of the given reports again and stores its rows in place of theirs; no extraction is added."""
        if self._open(batch) is None:
            return False
        with self.staged() as folder:
            asked = self.every("extractions").join(report_ids.select("report_id").distinct(), "report_id", "left_semi")
            newest = written(asked.groupBy("report_id").agg(F.max_by("raw", F.struct("seq", "extraction_id")).alias("text")), "asked", f"{folder}/asked")
            return self._replayed(batch, newest)

    def _replayed(self, batch: str, newest: DataFrame) -> bool:
        v = F.coalesce(F.try_variant_get("v", "$.report", "variant"), F.col("v"))
        read = newest.select("report_id", rp.answer(F.col("text")).alias("v")).select("report_id", v.alias("v"))
        read = read.where(F.try_variant_get("v", "$.metrics", "array<variant>").isNotNull())
        part = lambda path, kind="string": F.try_variant_get("v", path, kind)
        headers = read.select("report_id", part("$.provider").alias("provider"), part("$.category").alias("category"), F.to_date(part("$.reportDate")).alias("report_date"))
        held = self.current("reports").select("report_id", "file_path", "file_hash")
        items = parsers.json_report().table(read.select("report_id", F.col("v").cast("string").alias("text")))
        rows = items.select("report_id", "nth", "name", "panel", F.col("numeric").alias("value"), F.col("text").alias("value_text"), "units", F.col("low").alias("ref_low"), F.col("high").alias("ref_high"), "ref_text", "flag")
        return self._store(batch, headers.join(held, "report_id"), lambda heads: rows.join(heads, "report_id"), extraction=False)

    def _store(self, batch: str, headers: DataFrame, rows_of: Callable[[DataFrame], DataFrame], extraction: bool = True) -> bool:
        """rows_of: from report_id and provider of the batch's reports to their rows with their provider."""
        if self._open(batch) is None:
            return False
        # All tables of a batch come from these two, which are worked out once and go when the batch is written.
        with self.staged() as folder:
            headers = written(headers.select("report_id", *[c for c in columns(HEADERS) if c in headers.columns]), "headers", f"{folder}/headers")
            rows = written(rows_of(headers.select("report_id", "provider")).select("report_id", "provider", "nth", *columns(ITEM)), "rows", f"{folder}/rows")
            metrics = ingest.resolved(rows, self.current("aliases")).withColumn("panel_id", ingest.panel_id())
            tables = {"reports": headers, "panels": ingest.panels_of(rows), "metrics": metrics}
            if extraction:
                counts = rows.groupBy("report_id").agg(F.count("*").alias("metric_count"))
                told = headers.join(counts, "report_id", "left").withColumn("extraction_id", F.xxhash64("report_id", F.lit(batch)))
                tables["extractions"] = told.withColumn("metric_count", F.coalesce("metric_count", F.lit(0)))
            return self.write(batch, tables)

    def seed_aliases(self, batch: str, aliases: DataFrame) -> bool:
        """Sets the aliases (alias, alias_provider, canonical); rows that are stored keep what they have."""
        return self.write(batch, {"aliases": aliases})

    def map_names(self, batch: str, mapping: DataFrame, only_open: bool) -> bool:
        """Merges names into the aliases and the metrics. mapping: turn, alias, alias_provider ('' for all), canonical.

        An alias that is there gets the new target, another is added; of a name that is listed twice the last turn holds.
        only_open: metrics without a target get that of the name's first turn, as after a run over many names. Else all metrics of
        the name, under the alias's provider if it has one, get the new target, as after a mapping by hand."""
        if self._open(batch) is None:
            return False
        key = mapping.select("turn", normalize_name(F.col("alias")).alias("alias"), normalize_name(F.col("alias_provider")).alias("alias_provider"), "canonical").where("alias <> ''")
        last = key.groupBy("alias", "alias_provider").agg(F.max_by("canonical", "turn").alias("canonical"))
        aliases = self.current("aliases").join(last, ["alias", "alias_provider"], "left_anti").unionByName(last)
        reports, pick = self.current("reports"), F.min_by if only_open else F.max_by
        wanted = key.groupBy("alias", "alias_provider").agg(pick(F.struct("turn", "canonical"), "turn").alias("x")).select("alias", "alias_provider", "x.turn", "x.canonical")
        scoped = F.map_from_entries(F.collect_list(F.struct("alias_provider", F.struct("turn", "canonical"))))
        wanted = facts.measured(wanted.groupBy("alias").agg(scoped.alias("targets")), wanted)  # a name's providers
        rows = self.current("metrics").join(reports.select("report_id", normalize_name(F.col("provider")).alias("_provider")), "report_id")
        rows = rows.withColumn("alias", normalize_name(F.col("name"))).join(wanted, "alias", "left")
        both = F.array_compact(F.array(F.element_at("targets", F.col("_provider")), F.element_at("targets", F.lit(""))))
        ordered = F.array_sort(F.array_distinct(both))
        target = F.try_element_at(ordered, F.lit(1 if only_open else -1))["canonical"]
        free = F.col("canonical").isNull() if only_open else F.lit(True)
        rows = rows.withColumn("_new", F.when(free, F.coalesce(target, "canonical")).otherwise(F.col("canonical")))
        touched = F.max(~F.col("_new").eqNullSafe(F.col("canonical"))).over(W.partitionBy("report_id"))  # one report's rows
        changed = rows.withColumn("_touched", touched).where("_touched").withColumn("canonical", F.col("_new"))
        # The rows that changed say which reports did.
        self._write_table("metrics", batch, changed.select(*columns(SCHEMAS["metrics"])))
        ids = self.spark.read.schema(SCHEMAS["metrics"]).parquet(f"{self.root}/metrics/batch={batch}").select("report_id").distinct()
        again = lambda t: t.join(ids, "report_id", "left_semi")
        return self.write(batch, {"reports": again(reports), "panels": again(self.current("panels")), "aliases": aliases})
