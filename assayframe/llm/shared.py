"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Java and Python regex of a word that ends at ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only if its measured rows times its row width stay below this; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 24 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in local mode a new one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="assayframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never used twice, so a rerun never reads another run's files."""
    return f"{shared_root(spark)}/assayframe/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs a reread only."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (already cut) with a broadcast hint if its rows, counted, fit the limit; unchanged otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def measured_broadcast(df: DataFrame, size: Column, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (already cut) with a broadcast hint if its rows, of row_bytes and the bytes that `size` gives each, fit the limit."""
    total = df.agg(F.sum(F.coalesce(size.cast("long"), F.lit(0)) + row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(*dfs: DataFrame) -> None:
    """Deletes the files of DataFrames made by cut() that nothing will read again."""
    for df in dfs:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)


def released(batches: Iterator[T]) -> Iterator[T]:
    """The batches of a task; behind the last one the worker, which Spark keeps for other tasks, gives free memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs inside run under a setting of the session, which is as before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bytes that Spark gathers in a batch for a worker, in its own memory and then in the worker's, instead of 10,000 rows of any length.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Makes Spark delete the shuffle files of a job when it has ended, not when the driver happens to forget its plan.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_tidily(df: DataFrame, name: str) -> DataFrame:
    """cut() that leaves no shuffle files behind; an executor lost while it runs still costs its own stages only."""
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):
        return cut(df, name)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def open_store(uri: str):
    """pyarrow file system and path of a URI, for tasks that write or read byte ranges."""
    from pyarrow import fs

    if "://" not in uri and re.match(r"file:/+", uri):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered; forgets everything at `limit` words to bound memory."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers, in place on a copy."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    block, size, total, done = words, 1, np.zeros(len(words), np.uint64), 0
    with np.errstate(over="ignore"):
        while size <= n:  # blocks of 1, 2, 4, ... words; those of n's binary digits make up the window
            shift = np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64))
            if n & size:
                k = len(words) - done - size + 1
                total, done = total[:k] * shift + block[done : done + k], done + size
            k = len(words) - 2 * size + 1
            if k <= 0:
                break
            block, size = block[:k] * shift + block[size : size + k], 2 * size
    return mix64(total)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() splits at exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
