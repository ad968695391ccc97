"""Operator 4 against all pairs in plain Python."""

import random
import re

import duckdb
import pytest

from assayframe.llm import components, neardup

SF = "/root/testdata/sf0.001"


def brute(rows):
    sets = []
    for doc_id, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return sorted((d, len(s), top(d), top(d) == d) for d, s in sets)


def planted():
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(4000)
    rows, texts = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")], []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 25)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    big = [word() for _ in range(200)]
    for _ in range(60):
        t = list(big)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(200)] = word()
        texts.append("\t".join(t).upper())
    rng.shuffle(texts)
    return rows + [(100 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["planted", "sf"])
def test_near_dedup(spark, docs_table, name):
    if name == "sf":
        folder, rows = SF, duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    else:
        folder = docs_table(rows := planted())
    got = neardup.op4_near_dedup(spark, folder).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_null_id_empty_and_other_columns(spark, docs_table):
    docs = spark.read.parquet(docs_table([(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")]) + "/documents.parquet")
    got = neardup.near_duplicates(docs)
    assert sorted(map(str, [tuple(r) for r in got.select("doc_id", "component_id", "kept").collect()])) == sorted(map(str, [(None, None, True), (4, 4, True), (9, 4, False)]))
    assert got.columns == [*docs.columns, "n_shingles", "component_id", "kept"]
    assert neardup.near_ids(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_files_of_finished_steps_go(spark):
    from pathlib import Path

    from assayframe.llm import neardup
    from assayframe.llm.shared import shared_root

    root = Path(shared_root(spark).removeprefix("file://").removeprefix("file:")) / "assayframe"
    before = set(root.glob("*")) if root.exists() else set()
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "some other words that are far from it"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_ids(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    left = {p.name.rsplit("-", 1)[0] for p in set(root.glob("*")) - before}
    assert "near-ids" in left and not left & {"near-signed", "near-signatures", "near-postings", "near-top", "near-open", "near-likely", "near-sets"}


def family():
    """Copies of one text with so many own changes that few pairs of them are similar enough."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(80):
        t = list(base)
        for at in rng.sample(range(150), 7):
            t[at] = f"own{k}-{at}"
        texts.append((k, " ".join(t)))
    return texts


def test_unlike_copies_of_one_text_are_refuted_inside_the_join(spark, docs_table, monkeypatch):
    tried, old = [], neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda likely, docs: tried.append(likely.count()) or old(likely, docs))
    got = neardup.op4_near_dedup(spark, docs_table(rows := family())).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert sum(tried[2:]) < len(rows), tried  # behind the two steps that try a pair a member


def test_parities_refute_no_similar_sets(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 3, 6, 60, 600, 6000):
        for _ in range(20):
            both, own = rng.integers(0, 2**63, 6 * n, np.uint64), rng.integers(0, 2**63, 2 * n, np.uint64)
            x, y = np.unique(np.append(both, own[:n])), np.unique(np.append(both, own[n:]))  # a similarity of exactly 0.75
            rows.append((len(x), len(y), neardup.parities(x).tolist(), neardup.parities(y).tolist()))
    df = spark.createDataFrame(rows, "nx long, ny long, x array<long>, y array<long>")
    assert df.where(neardup.may_be_similar("nx", "ny", "x", "y")).count() == len(rows)
    far = [(100, 100, neardup.parities(rng.integers(0, 2**63, 100, np.uint64)).tolist(), neardup.parities(rng.integers(0, 2**63, 100, np.uint64)).tolist())]
    assert spark.createDataFrame(far, df.schema).where(neardup.may_be_similar("nx", "ny", "x", "y")).count() == 0
