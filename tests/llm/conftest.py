import pytest


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a table of a fresh folder and returns the folder."""

    def make(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long, count long"


@pytest.fixture
def docs_table(table):
    """Documents with an extra column of a clashing name; rows are (doc_id, text) or longer."""
    return lambda rows: table("documents", [(*r, *[None] * (6 - len(r))) for r in rows], DOCS)
