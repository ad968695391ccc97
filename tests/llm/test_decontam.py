"""Operator 3 against plain Python and its SQL."""

import hashlib
import re

import duckdb
import pytest

from assayframe.llm import decontam

SF = "/root/testdata/sf0.001"
A = " ".join(f"term{i}" for i in range(20))
EDGE_DOCS = [
    (1, None), (2, ""), (3, "... !"), (4, A), (5, f"Before, {A.upper()}; after"), (5, f"Before, {A.upper()}; after"), (6, "tiny item"), (7, "x " * 500 + "Tiny, ITEM"),
    (8, "été Ça va"), (9, "été ça va"), (10, " ".join(f"term{i}" for i in range(12))), (11, "a b a b a b a b a b a b a b a b"), (None, A), (12, A.replace("term7 ", "term7 extra ")),
]
EDGE_ITEMS = [(1, A), (2, "tiny item"), (3, None), (4, " ,"), (5, "Été Ça va"), (6, " ".join(f"term{i}" for i in range(4, 18))), (7, "a b a b a b a b a b a b a b"), (10, "été ça va")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    got |= found
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(params=["edge", "sf"])
def folder(request, docs_table, table):
    if request.param == "sf":
        return SF, *(duckdb.sql(f"select * from '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    docs_table(EDGE_DOCS)
    return table("benchmark", EDGE_ITEMS, "item_id long, text string"), EDGE_DOCS, EDGE_ITEMS


def test_decontaminate(spark, folder):
    path, docs, items = folder
    got = sorted(map(tuple, decontam.op3_decontaminate(spark, path).collect()), key=repr)
    assert got == brute([r[:2] for r in docs], items)


def test_proximity(spark, docs_table, table):
    docs = spark.read.parquet(docs_table(EDGE_DOCS) + "/documents.parquet")
    bench = spark.createDataFrame([(1, " ".join(f"term{i}" for i in range(13)))], "item_id long, text string")
    assert {4, 5, 12} <= {r[0] for r in decontam.proximity_matches(docs, bench).collect()}


def test_empty(spark, docs_table, table):
    docs_table([])
    assert decontam.op3_decontaminate(spark, table("benchmark", EDGE_ITEMS, "item_id long, text string")).count() == 0
    docs_table(EDGE_DOCS)
    got = decontam.op3_decontaminate(spark, table("benchmark", [], "item_id long, text string"))
    assert got.where("n_hit > 0").count() == 0 and got.count() == len(EDGE_DOCS)


def test_sql(folder):
    path, docs, items = folder
    con = duckdb.connect()
    glob = "/*.parquet" if path != SF else ""
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet{glob}'")
    assert sorted(con.execute(decontam.OP3_SQL).fetchall(), key=repr) == brute([r[:2] for r in docs], items)
