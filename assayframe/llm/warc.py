"""Operator 1: WARC archives, written by tasks, indexed first, and read back by coalesced byte ranges.

Every page becomes one record. Of records with equal payloads of REVISIT_BYTES or more the one with the largest page_id
is the response and the others are revisits of it; smaller payloads are always responses. Each record is a gzip member
of its own, so that any record can be read alone. The writer returns an index row per record: archive, offset, length,
URL, digest and type. A reader selects index rows, sorts them by archive and offset, joins neighbours into one range
read, and parses the records from it.

Archives have unique names and are only known by the index, which is written last: what a lost or repeated task left
behind is never read.

Edge cases: null html is an empty payload; a null url is written as `urn:null`; rows that repeat with the same largest
page_id are all responses; a null page_id never is the largest, and if all ids of a payload are null its records are
responses; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.shared import cut, open_store, sized_broadcast, work_path

REVISIT_BYTES = 1000
#: An archive is closed at about so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Selected records at most so far apart are read together, up to so many bytes a read.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20

#: Bytes of records that a reading task gets on average.
TASK_BYTES = 4 << 20

INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of each page.

    Digests with more than one page are found by a pre-aggregated count over ids and digests alone; the payloads then
    meet that short table in a plain equi-join, which Spark broadcasts if small and otherwise can split where one
    digest is very frequent.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    repeated = (
        rows.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
        .select(F.col("digest").alias("d"), "first_id")
    )
    repeated = sized_broadcast(cut(repeated, "warc-repeated"), 64)
    is_revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = rows.join(repeated, F.col("digest") == F.col("d"), "left")
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(is_revisit, F.col("first_id")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers only. Digests are base32 as the format asks."""
    body = b"" if kind == "revisit" else payload
    name = f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if kind == 'revisit' else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {clean_uri(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {name}",
        f"WARC-Original-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def clean_uri(url: str | None) -> str:
    return "urn:null" if url is None else re.sub(r"[\r\n]", " ", url)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(typed: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes typed pages below folder (a URI all executors can write) and returns the index, already materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page_id, url, payload, digest, kind, refers_to = r
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip_member(record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, kind, refers_to))
                out.write(member)
                rows.append((name, at, len(member), page_id, url, digest, kind))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, INDEX_TYPES, strict=True)], names=INDEX_NAMES
            )
        if out is not None:
            out.close()

    return cut(typed.mapInArrow(write, INDEX), "warc-index")


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
INDEX_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]


def parse(data: bytes) -> dict:
    """The fields of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda key: None if (v := fields.get(key, "<urn:page:None>")[10:-1]) == "None" else int(v)
    url = fields["WARC-Target-URI"]
    return {
        "page_id": number("WARC-Record-ID"), "url": None if url == "urn:null" else url, "record_type": fields["WARC-Type"],
        "payload": body, "payload_bytes": int(fields["WARC-Original-Payload-Length"]), "payload_digest": digest,
        "refers_to": number("WARC-Refers-To"),
    }


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, start, end, [(offset, length)]) of reads that cover sorted records, neighbours joined."""
    part: list[tuple[int, int]] = []
    where, start, end = None, 0, 0
    for archive, offset, length in rows:
        if part and (archive != where or offset > end + gap or offset + length - start > most):
            yield where, start, end, part
            part = []
        if not part:
            where, start, end = archive, offset, offset
        part.append((offset, length))
        end = max(end, offset + length)
    if part:
        yield where, start, end, part


def read_records(index: DataFrame, folder: str, columns: str = RECORD) -> DataFrame:
    """The records of selected index rows, in the given columns. Rows are dealt by archive and stretch of TASK_BYTES over as
    many tasks, sorted, and read by joined ranges, so a task reads each stretch once whatever was selected in it."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]
    stretch = F.floor(F.col("offset") / TASK_BYTES)
    chosen = index.select("archive", "offset", "length", stretch.alias("stretch"))
    # Index rows are few bytes each; a stated number of partitions keeps Spark from putting all stretches into one task.
    size = chosen.agg(F.sum("length")).first()[0] or 0
    chosen = chosen.repartition(max(1, min(-(-size // TASK_BYTES), 20_000)), "archive", "stretch")
    chosen = chosen.sortWithinPartitions("archive", "offset").drop("stretch")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fs, base = open_store(folder)
        for batch in batches:
            for archive, start, end, parts in ranges(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
                with fs.open_input_file(f"{base}/{archive}") as f:
                    data = memoryview(f.read_at(end - start, start))
                found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in parts]
                for r in found:
                    if r["record_type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != r["payload_digest"]:
                        raise ValueError(f"{archive}: page {r['page_id']} doesn't have the digest of its header")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, types, strict=True)], names=names)

    return chosen.mapInArrow(read, columns)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    index = write_archives(with_types(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    columns = ", ".join(c for c in RECORD.split(", ") if not c.startswith("payload binary"))
    return read_records(index, folder, columns)


OP1_SQL = """
with p as (select page_id, url, coalesce(html, '') as html from pages),
q as (select page_id, url, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
m as (select payload_digest, max(page_id) as first_id from q where payload_bytes >= 1000 group by payload_digest)
select q.page_id, q.url, q.payload_bytes, q.payload_digest,
  case when m.first_id is not null and q.page_id is distinct from m.first_id then 'revisit' else 'response' end as record_type,
  case when m.first_id is not null and q.page_id is distinct from m.first_id then m.first_id end as refers_to
from q left join m on q.payload_digest = m.payload_digest
"""
