"""Operator 12 against plain Python."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from assayframe.llm import bytesuffix

SF = "/root/testdata/sf0.001"


def brute(rows):
    first, rows = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, t in rows:
        x = float("inf") if d is None else d
        for i in range(len(t) - 49):
            k = t[i : i + 50]
            first[k] = min(first.get(k, x), x)
    out = []
    for d, t in rows:
        x, gone = float("inf") if d is None else d, bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < x:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passages = ["".join(rng.choice("abcdefgh ß🦆") for _ in range(n)) for n in (40, 49, 50, 51, 60, 90, 300)] + ["a" * 120, "ab" * 60, "xyz" * 40]
    rows = [(1, None), (2, ""), (3, "short"), (4, "q" * 49), (6, "q" * 51)]
    for i in range(120):
        t = ""
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            lo = rng.randrange(0, max(1, len(p) - 45))
            t += " ".join(word() for _ in range(rng.randrange(12))) + p[lo : rng.randrange(lo, len(p)) + 1 if rng.random() < 0.5 else None]
        rows.append((10 + i, t))
    rows += [(300 + i, " ".join(word() for _ in range(8)) + " a common line that very many of these texts have in their middle " + " ".join(word() for _ in range(8))) for i in range(60)]
    rows += [(200, rows[20][1]), (200, rows[20][1]), (5, rows[30][1]), (None, rows[40][1]), (201, rows[41][1]), (201, rows[42][1]), (None, "solo" * 30), (None, "solo" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("name,hot", [("planted", 64), ("planted", 2), ("sf", 64)])
def test_byte_strings(spark, docs_table, monkeypatch, name, hot):
    """Blocks and buckets of a few hundred bytes, and texts in short pieces, so that all ways are gone."""
    if name == "planted":
        for constant, value in (("BLOCK_BYTES", 1500), ("BUCKET_BYTES", 2500), ("PIECE", 64)):
            monkeypatch.setattr(bytesuffix, constant, value)
        rows = planted()
        docs = spark.read.parquet(docs_table(rows) + "/documents.parquet")
    else:
        rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, bytesuffix.digests(docs, hot).collect()), key=repr) == brute(rows)


def test_equal_windows_pick_equal_grams():
    rng = np.random.default_rng(4)
    for kinds in (1, 2, 3, 200):
        for _ in range(200):
            middle = rng.integers(0, kinds, 50).astype(np.uint8)
            found = set()
            for _ in range(2):
                a, b = (rng.integers(0, kinds, rng.integers(0, 60)).astype(np.uint8) for _ in range(2))
                grams, pick = bytesuffix.picks(np.concatenate([a, middle, b]))
                found.add((int(grams[pick[len(a)]]), int(pick[len(a)]) - len(a)))
            assert len(found) == 1


def test_deep_shallow_order():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 20, 40)))) for _ in range(300)]
    texts = [(t + b"c" * 60)[:50] for t in texts] + [b"z" * 50] * 3
    leaves = bytesuffix.blind_trie(texts)
    assert [texts[x[0]] for x in leaves] == sorted(set(texts)) and all(len({texts[i] for i in x}) == 1 for x in leaves)
    blob = np.frombuffer(b"".join(texts), np.uint8)
    deep = bytesuffix.multikey(blob, np.arange(len(texts)) * 50, np.zeros(len(texts), np.int64))
    heads = [t[: bytesuffix.SHALLOW] for t in texts]
    assert sorted(sorted(x.tolist()) for x in deep) == sorted([i for i, h in enumerate(heads) if h == k] for k in set(heads) if heads.count(k) > 1)


def test_empty(spark, docs_table):
    assert bytesuffix.op12_suffix_dedup(spark, docs_table([])).count() == 0
