"""The training-data pipeline: five stages over documents, each written and read again before the next.

Stages decide on rows, not on doc_ids, so a null or repeated doc_id joins nothing. `run` numbers the rows once in column
ROW; a stage that is called on other documents numbers them by their file and place in it, so texts aren't written again.
Only documents that don't come from files row by row are written with numbers first.

Edge cases: a null or empty text, or one without letters, has no language and goes in the first stage; rows that repeat
an earlier one's text are near duplicates of it and go in the second, whatever their ids; a null doc_id is kept and told
apart by its row; of equal rows that contamination finds all go; very long texts are read in whole; ties are settled by
the operators' rules; columns that documents have besides are carried along under their names, those named like an
operator's own results included; an empty table gives no rows. A document's column named as ROW is taken for the number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm import decontam, langid, mixing, neardup, tokens
from assayframe.llm.shared import cut, cut_tidily, drop_cut


#: A unique number of each row.
ROW = "_pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with column ROW, the same numbers at each reading: by file and place, or written if rows have none or share one."""
    if ROW in docs.columns:
        return docs
    file, at = f"{ROW}_file", f"{ROW}_at"
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        placed = None
    if placed is not None:
        # A row a file.
        files = cut(placed.select(file).distinct().select(file, F.row_number().over(W.orderBy(file)).cast("long").alias(ROW)), "pipeline-files")
        number = F.shiftleft(F.col(ROW), 40) + F.col(at)
        rows = placed.join(F.broadcast(files), file).withColumn(ROW, number).drop(file, at)
        if rows.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return rows
        drop_cut(files)
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the models don't reject."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"), "text")
    return langid.identify(rows, langid.train(docs)).where("not rejected").select("_document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates."""
    rows = numbered(docs)
    return rows.join(neardup.kept_rows(rows, ROW), ROW, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that benchmark passages contaminate; their key is a hash of id and text, on which alone it depends."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontam.contamination(docs, bench).where("contaminated").select(F.col("key").alias("_key")).distinct()
    bad = cut(bad, "pipeline-bad")
    return docs.join(bad, decontam.row_key() == bad["_key"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows so that each source's words come near its target."""
    rows = numbered(docs)
    copies = mixing.mix(rows, row=(ROW,)).where("copies > 0")
    copies = copies.select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select(ROW)
    return rows.join(copies, ROW).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the mix into token shards and reports each document's place in them."""
    return tokens.encode_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Trained models and encoded ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first stage reads its rows once into what it writes, so their numbers hold from there on.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(ROW, F.monotonically_increasing_id())
    written = []
    for name, stage in STAGES[:-1]:
        docs = cut_tidily(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_cut(*written)  # the stage's own documents, now that its result is written
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
