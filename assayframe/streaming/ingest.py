"""Streaming ingest of documents: each content hash once, in a table that appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def start_ingest(spark: SparkSession, incoming: str, store: str, checkpoint: str, schema: str, files_per_batch: int = 100) -> StreamingQuery:
    """Reads new parquet files of `incoming` and appends rows whose content is not in `store` yet; ends when it is caught up.

    A batch is deduplicated in itself and by an anti-join against the store. Its rows go to a folder named by the batch,
    overwritten when the batch is repeated after a failure, so each batch counts once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)

    def append(batch: DataFrame, number: int) -> None:
        rows = hashed(batch).groupBy("file_hash").agg(F.min_by(F.struct(*batch.columns), F.struct(*[c for c in batch.columns if c != "text"])).alias("r")).select("file_hash", "r.*")
        if number:
            held = batch.sparkSession.read.parquet(store).where(F.col("batch") < number).select("file_hash")
            rows = rows.join(held, "file_hash", "left_anti")
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
