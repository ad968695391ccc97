"""Steps written to folders that the driver and all executors see, and the shuffle files that they leave."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assayframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Makes Spark delete the shuffle files of a job when it has ended, not when the driver happens to forget its plan.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Files of steps and of the store take some half of the disk that Spark's default needs.
COMPRESSION = "zstd"


@contextmanager
def tidily(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def written(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """rows written to a folder that all see, and read from there, so that what reads them several times works them out once."""
    spark = rows.sparkSession
    path = path or work_folder(spark, name)
    with tidily(spark):
        rows.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
