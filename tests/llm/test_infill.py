"""Operator 11 against plain Python and its SQL."""

import hashlib
import random

import duckdb
import pytest

from assayframe.llm import infill

SF = "/root/testdata/sf0.001"


def brute(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for d, t in rows:
        t = t or ""
        x = sha("1:" + ("" if d is None else str(d)))
        h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
        n = len(t)
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            out.append((d, n, "plain", None, None, sha(t), sha(t)))
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        spm = h[3] % 100 < 20
        out.append((d, n, "spm" if spm else "psm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "a"), (None, "no number äöü"), (None, "no number äöü"), (7, "x" * 300_000 + "é🦆" * 100_000), (8, "holds <P> one"), (9, "<M>"), (10, "< P><S >")]
    for i in range(300):
        rows.append((100 + i, "".join(rng.choice("ab é🦆߷ࠀ￿\U0010ffff\n<PSM>") for _ in range(rng.randrange(60)))))
    return rows + rows[20:24]


@pytest.mark.parametrize("name", ["planted", "sf"])
def test_fill_in_middle(spark, docs_table, name):
    folder, rows = (SF, duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()) if name == "sf" else (None, planted())
    got = sorted(map(tuple, infill.op11_fill_in_middle(spark, folder or docs_table(rows)).collect()), key=repr)
    assert got == brute(rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_sql(spark, docs_table):
    folder = docs_table([r for r in planted() if r[0] != 7])
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = sorted(db.execute(infill.OP11_SQL).fetchall(), key=repr)
    assert sorted(map(tuple, infill.op11_fill_in_middle(spark, folder).collect()), key=repr) == want


@pytest.mark.parametrize("unit,parts", [("word", lambda t: __import__("re").findall(r"^[ \n]+|[^ \n]+[ \n]*", t)), ("line", lambda t: [x for x in t.split("\n") if 0] or __import__("re").findall(r"[^\n]*\n|[^\n]+\Z", t))])
def test_other_units(unit, parts):
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice("ab é\n ") for _ in range(rng.randrange(1, 40)))
        data, want = t.encode(), parts(t)
        if unit == "line" and t.endswith("\n"):
            pass  # nothing starts behind the last line end
        bits = infill.starts(data, unit)
        assert bits.bit_count() == len(want)
        a, b = sorted((rng.randrange(len(want) + 1), rng.randrange(len(want) + 1)))
        assert infill.cut_at(data, bits, a, b) == tuple("".join(x).encode() for x in (want[:a], want[a:b], want[b:]))


def test_bytes_without_characters():
    for data, n in ((b"\x80\x80", 2), (b"\xc3", 1), (b"a\xe2\x82", 2), (b"\xf0\x9f\xa6\x86\x86", 2), (b"\xc3\xa9\xa9", 2)):
        assert infill.starts(data).bit_count() == n


def test_empty(spark, docs_table):
    assert infill.op11_fill_in_middle(spark, docs_table([])).count() == 0
