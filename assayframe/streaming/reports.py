"""Streaming ingest of answers: each micro-batch of texts is parsed and stored as one batch of the report store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayframe.operators import parsers
from assayframe.sources.store import ReportStore

INCOMING = "file_path string, provider string, category string, report_date date, text string"


def start_reports(spark: SparkSession, incoming: str, store: ReportStore, checkpoint: str, registry: list[parsers.Parser] | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Reads new parquet files of `incoming` (INCOMING) and stores the reports that a parser reads; ends when it is caught up.

    A batch is named by its number, and the store commits a name once, so a batch that is repeated after a failure is stored
    once. A text that is stored already, by its hash, is left out; one that no parser reads is left out too, and found by
    `parsers.parse`. Null texts are no reports."""
    stream = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)

    def keep(batch: DataFrame, number: int) -> None:
        texts = batch.where("text is not null").withColumn("file_hash", F.sha2("text", 256))
        once = texts.groupBy("file_hash").agg(F.min_by(F.struct(*batch.columns), "file_path").alias("r")).select("file_hash", "r.*")
        with store.staged() as folder:
            store_batch(once, number, folder)

    def store_batch(once: DataFrame, number: int, folder: str) -> None:
        rows, told = parsers.parse(once.select(F.col("file_hash").alias("report_id"), "text"), registry or parsers.REGISTRY, folder)
        read = told.where("parser is not null").select(F.col("report_id").alias("file_hash"), F.col("parser").alias("model"), F.col("version").alias("extractor_version"))
        headers = once.join(read, "file_hash").withColumns({"extractor_kind": F.lit("deterministic"), "raw": F.col("text")}).drop("text")
        items = rows.select(F.col("report_id").alias("file_hash"), "nth", "name", "panel", F.col("numeric").alias("value"), F.col("text").alias("value_text"), "units", F.col("low").alias("ref_low"), F.col("high").alias("ref_high"), "ref_text", "flag")
        store.ingest(f"stream-{number}", headers, items)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
