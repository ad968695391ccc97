"""Operator 9 against plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from assayframe.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            x = float("inf") if d is None else d
            first[k] = min(first.get(k, x), x)
    out = []
    for d, w in split:
        x, gone = float("inf") if d is None else d, set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < x:
                gone |= set(range(i, i + 50))
        kept = " ".join(v for i, v in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(11)
    word = lambda n=300: "w%d" % min(rng.randrange(n), rng.randrange(n))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 130, 400)] + [["la"] * 70, ["a", "b"] * 45, ["x", "x", "y"] * 30]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "short text")]
    for i in range(80):
        t = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            lo = rng.randrange(0, max(1, len(p) - 45))
            t += [word() for _ in range(rng.randrange(30))] + p[lo : rng.randrange(lo, len(p)) + 1 if rng.random() < 0.5 else None]
        rows.append((10 + i, rng.choice(["\n", " ", "  "]).join(t)))
    rows += [(200, rows[20][1]), (200, rows[20][1]), (5, rows[30][1]), (None, rows[40][1]), (201, rows[41][1]), (201, rows[42][1]), (None, " ".join(["solo"] * 60))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", ["planted", "sf"])
def test_substring_dedup(spark, docs_table, name):
    folder, rows = (SF, duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()) if name == "sf" else (None, planted())
    got = substrings.op9_substring_dedup(spark, folder or docs_table(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_equal_windows_pick_equal_symbols():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 3, 8, 1000):
        for _ in range(300):
            names = rng.integers(0, 2**63, kinds).astype(np.uint64)
            middle = names[rng.integers(0, kinds, 50)]
            if rng.random() < 0.5:
                middle = np.repeat(middle, rng.integers(1, 5, 50))[:50]
            found = []
            for _ in range(2):
                a, b = (names[rng.integers(0, kinds, rng.integers(0, 9))] for _ in range(2))
                key, _, place = substrings.spans(np.concatenate([a, middle, b]))
                first, last = place >> 16, (place >> 16) + (place >> 8 & 255)
                found.append(key[(first <= len(a)) & (last >= len(a))][0])
            assert found[0] == found[1]


def test_empty(spark, docs_table):
    assert substrings.op9_substring_dedup(spark, docs_table([])).count() == 0
