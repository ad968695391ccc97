"""Operator 8 against plain Python and its SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from assayframe.llm import linedup

SF = "/root/testdata/sf0.001"


def brute(rows, run=1):
    """Lines of every run of `run` lines and more that occurs earlier, by looking at each earlier place; then stretches without blank ends."""
    blank = lambda x: not x.strip(" \t\n\r\x0b\x0c")
    once = sorted({(float("inf") if d is None else d, t) for d, t in rows if t is not None})
    split, answers = [(d, t, t.split("\n")) for d, t in once], {}
    where = {}
    for k, (_, _, ls) in enumerate(split):
        for i in range(len(ls) - run + 1):
            where.setdefault(tuple(ls[i : i + run]), []).append((k, i))
    for k, (d, t, ls) in enumerate(split):
        marked = set()
        for i in range(len(ls) - run + 1):
            longest = 0
            for j, at in where[tuple(ls[i : i + run])]:
                if (j, at) < (k, i):
                    n = run
                    while i + n < len(ls) and at + n < len(split[j][2]) and ls[i + n] == split[j][2][at + n]:
                        n += 1
                    longest = max(longest, n)
            marked |= set(range(i, i + longest))
        gone, runs, i = set(), 0, 0
        while i < len(ls):
            z = i
            while z < len(ls) and z in marked:
                z += 1
            solid = [x for x in range(i, z) if not blank(ls[x])]
            if solid:
                gone, runs = gone | set(range(solid[0], solid[-1] + 1)), runs + 1
            i = z + 1
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        answers[d, t] = (len(ls), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest())
    none = (0, 0, 0, hashlib.sha256(b"").hexdigest())
    return sorted(((d, *(answers[float("inf") if d is None else d, t] if t is not None else none)) for d, t in rows), key=repr)


def planted():
    """Runs of 1, 2, 5 and 40 lines, blank lines in and around them, a line on end, copies of texts."""
    rng = random.Random(4)
    lines = ["", " ", *(f"line {i}" for i in range(12))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    runs = [[f"run {n} {i}" if i % 7 != 3 else "" for i in range(n)] for n in (1, 2, 5, 40)]
    for i in range(40):
        body = []
        for n in range(rng.randrange(1, 4)):
            body += [f"own {i} {n}", *[""] * rng.randrange(3), *rng.choice(runs), *[""] * rng.randrange(3)]
        rows.append((200 + i, "\n".join(body)))
    return rows + [(100, None), (101, ""), (102, "\n\n\n\n"), (103, rows[3][1]), (None, rows[5][1]), (104, "same\n" * 9), (3, rows[3][1]), (3, rows[9][1])]


def answer(docs, run):
    got = linedup.remove_runs(docs, run).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("run", [1, 2, 3, 5, 6, 40])
def test_runs(spark, docs_table, run):
    rows = planted()
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert by_hash(answer(spark.read.parquet(docs_table(rows) + "/documents.parquet"), run)) == by_hash(brute(rows, run))


def by_hash(rows):
    """Texts of one doc_id are in the order of their hash there and of their text here; only how many they are is compared."""
    return [r for r in rows if r[0] != 3]


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = sorted(map(tuple, linedup.op8_line_dedup(spark, SF).collect()), key=repr)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(con.execute(linedup.OP8_SQL).fetchall(), key=repr) == got


def test_ranks_are_in_suffix_order(spark, docs_table):
    """Ranks of a level order suffixes by the ids of their first lines, and equal ranks are equal lines."""
    rows = [(1, "a\nb\na\nb\nc\na"), (2, "b\nc\na\nb\nc\na\nb\nc\nd"), (3, "c\na\nb")]
    docs = spark.read.parquet(docs_table(rows) + "/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(0).alias("row"), "text")
    lines, _ = linedup.line_places(docs)
    ids = [(r["a"], r["b"]) for r in lines.orderBy("place").collect()]
    places = {r["place"]: i for i, r in enumerate(lines.orderBy("place").collect())}
    left = [r["left"] for r in lines.orderBy("place").collect()]
    seen = []
    for h, level in linedup.levels(lines):
        got = {places[r["place"]]: r["rank"] for r in level.collect()}
        prefix = {i: tuple(ids[i : i + h]) for i in range(len(ids)) if left[i] >= h}
        assert set(got) == {i for i, p in prefix.items() if sum(q == p for q in prefix.values()) > 1}
        assert all((got[i] < got[j]) == (prefix[i] < prefix[j]) for i in got for j in got)
        seen.append(h)
    assert seen == [1, 2, 4]


def test_run_of_five(spark, docs_table):
    docs = spark.read.parquet(docs_table([(1, "a\nb\nc\nd\ne\nf"), (2, "x\nb\nc\nd\ne\nf\ny"), (3, "a\nb\nc\nd\ny")]) + "/documents.parquet")
    got = dict(linedup.remove_runs(docs, run=5).select("doc_id", "kept_text").collect())
    assert got == {1: "a\nb\nc\nd\ne\nf", 2: "x\ny", 3: "a\nb\nc\nd\ny"}


def test_empty(spark, docs_table):
    assert linedup.op8_line_dedup(spark, docs_table([])).count() == 0
