"""Operator 11: fill-in-the-middle by bit-parallel masks in Python's big integers.

A text is its UTF-8 bytes, a class of bytes a big integer with one bit a byte, the first byte's the highest. bytes.translate
gives each class as digits, which int() reads. Where units start then takes a handful of shifts and boolean operations on
whole texts: a byte that goes on a character is one that follows its lead byte closely enough. bit_count gives the number of
units, and the place of the k-th start is found by halving the integer and counting the half that holds it, so that all
halvings together cost as much as one pass.

Units are characters (code points), words with the white space behind them, or lines. A text is cut at two ranks into
prefix, middle and suffix, and written as `<P>`prefix`<S>`suffix`<M>`middle or `<S>`suffix`<P>`prefix`<M>`middle. `restored`
takes it apart again with built-in functions.

Edge cases: a null text is empty, an empty one stays plain; texts that hold a marker stay plain; a null doc_id hashes like
an empty number, repeated ones cut alike; a byte that belongs to no character is a unit of its own; very long texts are cut
in whole, and a batch is answered in slices; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = (b"<P>", b"<S>", b"<M>")
#: Of 100 texts that many are changed, and of 100 changed ones so many have their suffix first.
CHANGED, SUFFIX_FIRST = 90, 20


def digits(*ranges: tuple[int, int]) -> bytes:
    """The table of a class of bytes for bytes.translate: 1 in the ranges, else 0."""
    return bytes(49 if any(a <= b <= z for a, z in ranges) else 48 for b in range(256))


CONTINUED, LEADS_2, LEADS_3, LEADS_4 = digits((0x80, 0xBF)), digits((0xC2, 0xF4)), digits((0xE0, 0xF4)), digits((0xF0, 0xF4))
SPACE, NEWLINE = digits((0x20, 0x20), (0x09, 0x0D)), digits((0x0A, 0x0A))


def mask(data: bytes, table: bytes) -> int:
    return int(data.translate(table), 2) if data else 0


def starts(data: bytes, unit: str = "character") -> int:
    """A big integer with a bit for each byte at which a unit starts; the first byte's is bit len(data) - 1."""
    every = (1 << len(data)) - 1
    first = 1 << len(data) - 1 if data else 0
    if unit == "character":
        if data.isascii():
            return every
        going = mask(data, CONTINUED)
        second = mask(data, LEADS_2) >> 1 & going
        third = mask(data, LEADS_3) >> 2 & second >> 1 & going
        fourth = mask(data, LEADS_4) >> 3 & third >> 1 & going
        return every ^ (second | third | fourth)
    if unit == "word":
        space = mask(data, SPACE)
        return first | (space >> 1 & ~space & every)
    if unit == "line":
        return first | (mask(data, NEWLINE) >> 1)
    raise ValueError(f"no such unit: {unit}")


def place(bits: int, size: int, k: int) -> int:
    """The index, from the left, of the k-th set bit (from 0) of `size` bits; `size` if there is none."""
    if k >= bits.bit_count():
        return size
    at = 0
    while size > 1:
        right = size // 2
        left = bits >> right
        n = left.bit_count()
        if k < n:
            bits, size = left, size - right
        else:
            bits, size, at, k = bits & (1 << right) - 1, right, at + size - right, k - n
    return at


def cut_at(data: bytes, bits: int, a: int, b: int) -> tuple[bytes, bytes, bytes]:
    """data before its a-th unit, from there to its b-th, and from there on."""
    i, j = place(bits, len(data), a), place(bits, len(data), b)
    return data[:i], data[i:j], data[j:]


def slices(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of a binary column at most, one row at least."""
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > lo and size + (n or 0) > most:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n or 0
    if batch.num_rows > lo:
        yield batch.slice(lo)


NAMES = ["n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, unit: str = "character", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars and output of each row of (doc_id, text)."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = []
                for data, *h in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True):
                    bits = starts(data, unit)
                    n = bits.bit_count()
                    if not data or any(m in data for m in MARKERS) or h[2] % 100 >= changed:
                        found.append((n, "plain", None, None, None, None, data))
                        continue
                    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    prefix, middle, suffix = cut_at(data, bits, a, b)
                    chars = (a, b - a) if unit == "character" else (starts(prefix).bit_count(), starts(middle).bit_count())
                    if h[3] % 100 < suffix_first:
                        found.append((n, "spm", a, b - a, *chars, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle))
                    else:
                        found.append((n, "psm", a, b - a, *chars, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *NAMES])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from output and form alone; no text that holds a marker was cut, so markers part the pieces."""
    pieces = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output)
    )


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
with h as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
u as (select *, length(text) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from h),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, substring(text, 1, a) as pre, substring(text, a + 1, b - a) as mid, substring(text, b + 1) as suf from f)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
