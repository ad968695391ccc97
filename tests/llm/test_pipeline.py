"""The pipeline on nulls, repeated rows and ids, clashing columns and an empty table."""

import duckdb
import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected string, score long, kept string, _id long, size long"


@pytest.fixture
def folder(spark, table, tmp_path):
    rows = [(*r, "no", 7, "k", 3, 9) for r in duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()]
    hard = [(None, None, None, None, None), (5, "", "en", None, 0), (None, "12 34 !!", None, "web", 7)]
    item = duckdb.sql(f"select text from '{SF}/benchmark.parquet' where text is not null order by length(text) desc limit 1").fetchall()[0][0]
    plain = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    same = [(None, plain[1] + " and an end", "en", "web", 3), (None, plain[1] + " and an end", "en", "web", 3), (plain[0], item, "en", "web", 3)]
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return table("documents", rows + [(*r, None, None, None, None, None) for r in hard + same], SCHEMA)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = cp.identify_language(spark, docs, folder)
    assert known.columns == docs.columns
    assert known.where("text is null or text = '' or text like '12 34%'").count() == 0
    assert known.where("rejected = 'no' and score = 7").count() > 100
    known = cp.cut(known, "test-known")
    single = cp.cut(cp.drop_near_duplicates(spark, known, folder), "test-single")
    assert single.columns == docs.columns
    assert single.where("doc_id is null").count() <= 1
    assert single.select("text").distinct().count() == single.count()
    clean = cp.cut(cp.decontaminate(spark, single, folder), "test-clean")
    assert clean.columns == docs.columns and 0 < clean.count() < single.count()
    mixed = cp.mix_sources(spark, clean, folder)
    assert mixed.columns == docs.columns
    times = {r["k"]: r["count"] for r in mixed.groupBy(mixed["doc_id"].alias("k")).count().collect()}
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in clean.collect()}


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_write_no_copy_of_their_documents(spark, folder):
    from pathlib import Path

    from assayframe.llm.shared import shared_root

    root = Path(shared_root(spark).removeprefix("file://").removeprefix("file:")) / "assayframe"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = set(root.glob("*")) if root.exists() else set()
    assert cp.drop_near_duplicates(spark, docs, folder).count() > 100
    assert cp.mix_sources(spark, docs, folder).count() > 100
    assert not [p for p in set(root.glob("*")) - before if p.name.startswith("pipeline-rows")]


def test_numbers_are_unique_and_stay(spark, folder):
    files = spark.read.parquet(f"{folder}/documents.parquet").repartition(3)
    files.write.parquet(f"{folder}/several")
    docs = spark.read.parquet(f"{folder}/several")
    twice = docs.selectExpr("*", "explode(array(1, 2)) as k")
    made = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    for rows in (docs, docs.where("false"), twice, docs.union(docs), made):
        got = cp.numbered(rows)
        assert got.columns == [*rows.columns, cp.ROW] and dict(got.dtypes)[cp.ROW] == "bigint"
        first = [tuple(r) for r in got.select(cp.ROW, "doc_id", "text").collect()]
        assert len({r[0] for r in first}) == len(first) == rows.count()
        assert sorted(map(str, first)) == sorted(str(tuple(r)) for r in got.select(cp.ROW, "doc_id", "text").collect())
