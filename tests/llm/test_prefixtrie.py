"""Operator 13 against plain Python and its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from assayframe.llm import prefixtrie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, words long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own[c].append((role or "", text or ""))
    members, ends, built = defaultdict(list), defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        x = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
        ends[x].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        s, n = (len(members[p]) - 1) * words, 0 if kids[p] else 1
        for q in kids[p]:
            s, n = s + total[q][0], n + total[q][1]
        total[p] = s, n
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), total[p][1], total[p][0],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members)


def answer(spark, folder):
    got = prefixtrie.op13_prefix_trie(spark, folder).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, got.collect()))


def planted():
    """Snapshots of one growing conversation, forks at every depth, copies, long chains, null and equal turns."""
    rng, rows, c = random.Random(3), [], 0
    talk = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", f"say {i}", "  two words  "])) for i in range(40)]
    for n in range(0, 40, 3):
        rows += [(c := c + 1, i, *t) for i, t in enumerate(talk[:n])]
    for n in range(2, 40, 5):
        rows += [(c := c + 1, i, *t) for i, t in enumerate(talk[:n] + [("user", f"fork {n} {j}") for j in range(rng.randrange(4))])]
    for _ in range(60):
        rows += [(c := c + 1, i, "user", rng.choice("ab")) for i in range(rng.randrange(1, 6))]
    for x in (5000, 5020, 9001):
        rows += [(x, i, "assistant", f"long {i}") for i in range(150)]
    rows += [(700, None, "user", "b"), (700, None, "user", "a"), (700, None, None, None), (700, 0, "user", "a"), (700, 0, "user", "a"), (None, 1, "user", "nobody"), (741, 9, "user", "one")]
    rows += [(100_000 + i, 0, "user", "copied") for i in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", ["planted", "sf"])
def test_prefix_trie(spark, table, name):
    rows = planted() if name == "planted" else duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    folder = table("conversations", [(*r, "x", 1) for r in rows], SCHEMA) if name == "planted" else SF
    assert answer(spark, folder) == brute(rows)


def test_sql(spark, table):
    folder = table("conversations", [(*r, "x", 1) for r in planted()], SCHEMA)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    assert answer(spark, folder) == sorted(db.execute(prefixtrie.OP13_SQL).fetchall())


def test_one_conversation_over_many_tasks(spark, table):
    rows = [(40, i, "user", f"turn {i}") for i in range(3000)] + [(41, i, "user", f"turn {i}") for i in range(2000)] + [(60, 0, "user", "turn 0")]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert answer(spark, table("conversations", [(*r, None, None) for r in rows], SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_empty(spark, table):
    assert answer(spark, table("conversations", [], SCHEMA)) == []
