"""Operator 12: repeated byte strings by sorting suffixes, deep-shallow.

A suffix is sorted by its first LENGTH bytes only, as equal ones are what is looked for, and only next to suffixes that it
may be equal to. Which these are is found first: each window of LENGTH bytes picks the gram of GRAM bytes of least hash in
it, the leftmost of equals, so equal windows pick equal grams. Documents are dealt into blocks by hash; a block posts each
gram hash once, as 32 bits in the array of the hash's bucket, and is told which of them another document has. Runs of
windows that pick one such gram are spans; a block posts each different span once, with its least and greatest doc_id.

A bucket has all spans of its grams. Where a gram has one span, all its windows are equal. Else the windows, grouped by gram
and the gram's place in them, are suffixes to sort: multikey quicksort to a depth of SHALLOW bytes, with characters of
CHARACTER bytes and all groups partitioned at once, then a blind trie for each group that is still together. Windows of one
leaf are equal, and the least doc_id of the leaf goes back to the blocks. Copies of a text or a passage thus cost a row per
block, not per document. Spans of grams that HOT or more blocks have are posted window by window, dealt by the window's own
hash, so that no bucket gathers all contexts of a common line.

Equal texts form a class first, and only its smallest doc_id is posted.

Edge cases: null and empty texts have no bytes; texts shorter than a window lose nothing and are never a source of removal;
equal doc_ids never remove each other; a null doc_id counts as above all others and loses what others have; very long texts
are read in pieces that share LENGTH - 1 bytes; cuts fall between any bytes, inside characters too; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.shared import cut, cut_tidily, drop_cut, measured_broadcast, mix64, sized_broadcast, window_hashes

LENGTH = 50
#: Bytes of a gram; shorter ones are posted less often, but more of them are equal by chance, the more the larger the corpus.
GRAM = 28
CHOICE = LENGTH - GRAM + 1
#: Windows of a text that are looked at together; a place has PLACE_BITS bits.
PIECE, PLACE_BITS = 1 << 19, 20
#: Bytes of text of a block and of a bucket: what one task has in memory at a time, however large the corpus is.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Blocks that share a gram from which on its windows are dealt by themselves.
HOT = 64
SHALLOW, CHARACTER = 24, 8
NULL_ID = 2**63 - 1
#: A fixed random number for each byte value.
BYTE_NAMES = np.random.default_rng(12).integers(1, 2**63, 256).astype(np.uint64)


def picks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram at each place, and the place of the gram that each window picks; at most PIECE windows."""
    grams = window_hashes(BYTE_NAMES[data], GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, size = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * size <= CHOICE:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if rest := CHOICE - size:
        least = np.minimum(least[:-rest], least[rest:])
    return grams, (least & low).astype(np.int64)


def spans(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Gram hash, first and last window and the gram's distance from the first, of each run of windows that pick one gram."""
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, len(data) - LENGTH + 1, PIECE):
        grams, pick = picks(data[lo : lo + PIECE + LENGTH - 1])
        first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        last = np.append(first[1:], len(pick)) - 1
        yield grams[pick[first]], first + lo, last + lo, pick[first] - first


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(buckets)


def short_names(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of each gram hash, in one number."""
    return bucket_of(keys, buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def grams_of(buckets: int):
    """For the documents of a block: rows of bucket, block, again (whether several of its documents have them) and grams."""

    def run(docs: pa.Table) -> pa.Table:
        found = [np.unique(np.concatenate([short_names(s[0], buckets) for s in spans(t.as_py())])) for t in docs.column("text")]
        names, n = np.unique(np.concatenate(found), return_counts=True)
        out = []
        for again in (False, True):
            part = names[(n > 1) == again]
            bucket, at = np.unique(part >> np.uint64(32), return_index=True)
            grams = pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            out.append(pa.table({
                "bucket": pa.array(bucket.astype(np.int64)), "block": pa.repeat(docs.column("block")[0], len(bucket)),
                "again": pa.repeat(again, len(bucket)), "grams": lists(np.append(at, len(part)), grams),
            }))
        return pa.concat_tables(out)

    return run


GRAM_SCHEMA = "bucket long, block long, again boolean, grams array<int>"


def shared_grams(hot: int):
    """For the rows of a bucket: block, bucket, hot and the grams of that block that another document has."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sizes = pc.list_value_length(rows.column("grams")).to_numpy()
        of = np.repeat(np.arange(rows.num_rows), sizes)
        grams = pc.list_flatten(rows.column("grams")).to_numpy()
        kind, n = np.unique(grams, return_inverse=True, return_counts=True)[1:]
        shared = n > 1
        shared[kind[np.repeat(rows.column("again").to_numpy(zero_copy_only=False), sizes)]] = True
        out = []
        for is_hot in (False, True):
            keep = (shared & ((n >= hot) == is_hot))[kind]
            row, at = np.unique(of[keep], return_index=True)
            out.append(pa.table({
                "block": rows.column("block").take(pa.array(row)), "bucket": rows.column("bucket").take(pa.array(row)), "hot": pa.repeat(is_hot, len(row)),
                "grams": lists(np.append(at, keep.sum()), pa.array(grams[keep])),
            }))
        return pa.concat_tables(out)

    return run


SHARED_SCHEMA = "block long, bucket long, hot boolean, grams array<int>"


def known(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(among, names), len(among) - 1)
    return among[at] == names


#: Spans of a bucket, numbered from base on, one behind the other and compressed in `spans`; a row of bucket -1 has the sizes and least doc_ids
#: of all the block's spans, its documents and the places of the spans in them.
SPAN_SCHEMA = (
    "bucket long, block long, base int, lead array<tinyint>, size array<tinyint>, least array<long>, spans binary, "
    "doc_id array<long>, row array<long>, at_doc array<int>, at_span array<int>, at array<long>"
)


def spans_of(buckets: int):
    """For the documents of a block and the grams that it shares: rows of SPAN_SCHEMA."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        block = (docs if docs.num_rows else shared).column("block")[0].as_py()
        kinds: dict[bool, list] = {False: [], True: []}
        for bucket, hot, grams in zip(*(shared.column(c) for c in ("bucket", "hot", "grams")), strict=True):
            names = grams.values.to_numpy().view(np.uint32).astype(np.uint64) | np.uint64(bucket.as_py() << 32)
            kinds[hot.as_py()].append(names)
        hot, cold = (np.sort(np.concatenate(kinds[k])) if kinds[k] else np.empty(0, np.uint64) for k in (True, False))
        numbers: dict[bytes, int] = {}
        places, about, least, ids = [], [], [], list(zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(), strict=True))

        def post(text: bytes, lead: int, bucket: int, doc: int, at: int) -> None:
            i = numbers.setdefault(text, len(about))
            if i == len(about):
                about.append((bucket, lead))
                least.append(ids[doc][0])
            elif ids[doc][0] < least[i]:
                least[i] = ids[doc][0]
            places.append((doc, i, at))

        seen = set()
        for doc, t in enumerate(docs.column("text")):
            if ids[doc] in seen:
                continue
            seen.add(ids[doc])
            text = t.as_py()
            for key, first, last, lead in spans(text):
                names = short_names(key, buckets)
                often = known(names, hot)
                at = np.flatnonzero(often | known(names, cold))
                for b, f, z, x, split in zip(*(c[at].tolist() for c in (names >> np.uint64(32), first, last, lead, often)), strict=True):
                    if split:
                        for w in range(z - f + 1):
                            window = text[f + w : f + w + LENGTH]
                            post(window, x - w, xxhash.xxh3_64_intdigest(window) % buckets, doc, f + w)
                    else:
                        post(text[f : z + LENGTH], x, b, doc, f)
        return span_rows(block, list(numbers), about, least, ids, places)

    return run


def span_rows(block: int, texts: list, about: list, least: list, ids: list, places: list) -> pa.Table:
    pack = zstandard.ZstdCompressor(level=1).compress
    bucket, lead = (np.array([a[i] for a in about], np.int64) for i in range(2))
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    kinds, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at, len(order))
    texts, least = [texts[i] for i in order], np.array(least, np.int64)[order]
    size = np.fromiter(map(len, texts), np.int8, len(texts))
    # The last row has the lists of the whole block, the others those of their bucket.
    split = lambda values, kind: lists(np.append(ends, 2 * len(order)), pa.array(np.tile(values, 2), kind))
    alone = lambda values, kind: lists(np.append(np.zeros(len(kinds) + 1, np.int64), len(values)), pa.array(values, kind))
    return pa.table({
        "bucket": pa.array(np.append(kinds, -1)), "block": pa.array(np.full(len(kinds) + 1, block)), "base": pa.array(np.append(at, 0), pa.int32()),
        "lead": split(lead[order], pa.int8()), "size": split(size, pa.int8()), "least": split(least, pa.int64()),
        "spans": pa.array([pack(b"".join(texts[a:z])) for a, z in zip(ends[:-1], ends[1:], strict=True)] + [None], pa.binary()),
        "doc_id": alone([d for d, _ in ids], pa.int64()), "row": alone([r for _, r in ids], pa.int64()),
        "at_doc": alone([p[0] for p in places], pa.int32()), "at_span": alone(number[[p[1] for p in places]] if places else [], pa.int32()),
        "at": alone([p[2] for p in places], pa.int64()),
    })


def characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The CHARACTER bytes from each place on, as a number that orders like them."""
    out = np.zeros(len(at), np.uint64)
    for i in range(CHARACTER):
        out = out << np.uint64(8) | data[at + i]
    return out


def multikey(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Multikey quicksort of the suffixes at `starts` to a depth of SHALLOW bytes, within groups: those of more than one
    suffix that are equal so far. Every round partitions each group by a pivot of its own into less, equal and greater;
    only the equal part goes on to the next character. What is alone is done."""
    order = np.argsort(group, kind="stable")
    who, group, depth, deep = order, group[order], np.zeros(len(order), np.int64), []
    while len(who):
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, len(group)))
        keep = np.repeat(size > 1, size)
        equal = keep & (depth >= SHALLOW)
        if equal.any():
            at = np.flatnonzero(equal)
            deep += np.split(who[at], np.flatnonzero(group[at][1:] != group[at][:-1]) + 1)
            keep &= ~equal
        who, group, depth = who[keep], group[keep], depth[keep]
        if not len(who):
            break
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, len(group)))
        word = characters(data, starts[who] + depth)
        pivot = np.repeat(word[edge + size // 2], size)
        part = np.repeat(np.arange(len(edge)) * 3, size) + (word >= pivot) + (word > pivot)
        order = np.argsort(part, kind="stable")
        who, group, depth = who[order], part[order], (depth + CHARACTER * (word == pivot))[order]
    return deep


class Leaf:
    __slots__ = ("text", "held")

    def __init__(self, text: bytes, held: list[int]):
        self.text, self.held = text, held


class Fork:
    __slots__ = ("at", "kids")

    def __init__(self, at: int, kids: dict[int, Leaf | Fork]):
        self.at, self.kids = at, kids


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Numbers of equal texts, in the texts' order. All have one length. A fork knows only the place at which its texts differ;
    a text goes down blindly, is compared once with the leaf it comes to, and is put in where the two part."""
    root: Leaf | Fork = Leaf(texts[0], [0])
    for i, s in enumerate(texts[1:], 1):
        node = root
        while type(node) is Fork:
            node = node.kids.get(s[node.at]) or next(iter(node.kids.values()))
        t = node.text
        if s == t:
            node.held.append(i)
            continue
        x = int.from_bytes(s) ^ int.from_bytes(t)
        at = (8 * len(s) - x.bit_length()) // 8
        above, node = None, root
        while type(node) is Fork and node.at < at:
            above, node = node, node.kids[s[node.at]]
        if type(node) is Fork and node.at == at:
            node.kids[s[at]] = Leaf(s, [i])
            continue
        fork = Fork(at, {t[at]: node, s[at]: Leaf(s, [i])})
        if above is None:
            root = fork
        else:
            above.kids[s[above.at]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is Leaf:
            out.append(node.held)
        else:
            stack += [node.kids[b] for b in sorted(node.kids, reverse=True)]
    return out


def least_of_windows(texts: pa.Array, key: np.ndarray, lead: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For different spans: where each one's windows begin in a list of all, and the least doc_id of each window."""
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    windows = size - LENGTH + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    found = np.repeat(least, windows)
    kind, n = np.unique(key, return_inverse=True, return_counts=True)[1:]
    several = np.flatnonzero(n[kind] > 1)
    if len(several):
        blob = b"".join(texts.take(pa.array(several)).to_pylist())
        span = np.repeat(several, windows[several])
        within = np.arange(len(span)) - np.repeat(np.cumsum(windows[several]) - windows[several], windows[several])
        starts = within + np.repeat(np.cumsum(size[several]) - size[several], windows[several])
        group = np.unique(kind[span] * LENGTH + lead[span] - within, return_inverse=True)[1]
        place = begin[span] + within
        for who in multikey(np.frombuffer(blob, np.uint8), starts, group):
            for same in blind_trie([blob[s : s + LENGTH] for s in starts[who].tolist()]):
                if len(same) > 1:
                    at = place[who[same]]
                    found[at] = found[at].min()
    return begin, found


def gram_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the gram at each place; grams of equal hashes only share a sort."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in (*range(0, GRAM - CHARACTER, CHARACTER), GRAM - CHARACTER):
            out = mix64(out + characters(data, at + i))
    return out


def answers(rows: pa.Table) -> pa.Table:
    """For the spans of a bucket: block, and number, first and last window of the runs of windows that a doc_id below the least
    one of the block's that have the span has too."""
    rows = rows.combine_chunks()
    lead, size, least = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("lead", "size", "least"))
    of = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("lead")).to_numpy())
    number = np.arange(len(of)) - np.searchsorted(of, of) + rows.column("base").to_numpy()[of]
    block = rows.column("block").to_numpy()[of]
    blob = b"".join(map(zstandard.ZstdDecompressor().decompress, rows.column("spans").to_pylist()))
    begin = np.concatenate([[0], np.cumsum(size)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(begin), pa.py_buffer(blob)]).dictionary_encode()
    span, texts = coded.indices.to_numpy(), coded.dictionary
    one = np.unique(span, return_index=True)[1]
    low = np.full(len(texts), NULL_ID, np.int64)
    np.minimum.at(low, span, least)
    names = gram_names(np.frombuffer(blob, np.uint8), (begin[:-1] + lead)[one])
    begin, found = least_of_windows(texts, names, lead[one], low)
    # Runs of windows of one span and least doc_id.
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    edge = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])]))
    end = np.append(edge[1:], len(found)) - 1
    runs = np.searchsorted(owner[edge], np.arange(len(texts) + 1))
    n = np.diff(runs)[span]
    entry = np.repeat(np.arange(len(span)), n)
    run = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + runs[span[entry]]
    keep = found[edge[run]] < least[entry]
    entry, run = entry[keep], run[keep]
    order = np.argsort(block[entry], kind="stable")
    entry, run = entry[order], run[order]
    blocks, at = np.unique(block[entry], return_index=True)
    offsets, base = np.append(at, len(entry)), begin[span[entry]]
    return pa.table({
        "block": pa.array(blocks.astype(np.int64)), "number": lists(offsets, pa.array(number[entry], pa.int32())),
        "first": lists(offsets, pa.array(edge[run] - base, pa.int8())), "last": lists(offsets, pa.array(end[run] - base, pa.int8())),
    })


ANSWER_SCHEMA = "block long, number array<int>, first array<tinyint>, last array<tinyint>"


def block_ranges(places: pa.Table, told: pa.Table) -> pa.Table:
    """For the places of a block's spans and what their buckets answered: the ranges of bytes that each document loses. A span
    that a smaller doc_id of the block has goes in whole, of others the windows that are answered."""
    names = ["doc_id", "row", "ranges"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    if not places.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    column = lambda t, c: pc.list_flatten(t.combine_chunks().column(c)).to_numpy() if t.num_rows else np.empty(0, np.int64)
    number, first, last = (column(told, c) for c in ("number", "first", "last"))
    order = np.argsort(number, kind="stable")
    number, first, last = number[order], first[order], last[order]
    ids, rows, size, least, doc, span, at = (column(places, c) for c in ("doc_id", "row", "size", "least", "at_doc", "at_span", "at"))
    later = ids[doc] > least[span]
    lo = np.searchsorted(number, span)
    n = np.where(later, 0, np.searchsorted(number, span, "right") - lo)
    entry = np.repeat(np.arange(len(span)), n)
    run = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + lo[entry]
    start = np.concatenate([at[later], at[entry] + first[run]])
    stop = np.concatenate([at[later] + size[span[later]], at[entry] + last[run] + LENGTH])
    doc = np.concatenate([doc[later], doc[entry]])
    order = np.lexsort((start, doc))
    start, stop, doc = start[order], stop[order], doc[order]
    out = []
    for i in np.split(np.arange(len(doc)), np.flatnonzero(doc[1:] != doc[:-1]) + 1) if len(doc) else []:
        out.append((int(ids[doc[i[0]]]), int(rows[doc[i[0]]]), merged(start[i], stop[i])))
    return pa.table([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=names)


RANGE_SCHEMA = "doc_id long, row long, ranges array<struct<start:long,stop:long>>"


def merged(start: np.ndarray, stop: np.ndarray) -> list[dict]:
    """Ranges in order of their starts, overlapping and adjoining ones joined."""
    reach = np.maximum.accumulate(stop)
    edge = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return [{"start": a, "stop": z} for a, z in zip(start[edge].tolist(), reach[np.append(edge[1:], len(start)) - 1].tolist(), strict=True)]


def removals(texts: DataFrame, n_bytes: int, hot: int = HOT) -> DataFrame:
    """doc_id, row and ranges of each of (doc_id, row, text of LENGTH bytes or more, binary) that loses bytes. n_bytes: of all texts."""
    blocks, buckets = max(1, -(-n_bytes // BLOCK_BYTES)), max(1, -(-n_bytes // BUCKET_BYTES))
    docs = texts.withColumn("block", F.pmod("row", F.lit(blocks)))
    grams = docs.groupBy("block").applyInArrow(grams_of(buckets), GRAM_SCHEMA)
    shared = cut_tidily(grams.groupBy("bucket").applyInArrow(shared_grams(hot), SHARED_SCHEMA), "byte-grams")
    posted = cut_tidily(docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(spans_of(buckets), SPAN_SCHEMA), "byte-spans")
    drop_cut(shared)
    told = posted.where("bucket >= 0").select("bucket", "block", "base", "lead", "size", "least", "spans").groupBy("bucket").applyInArrow(answers, ANSWER_SCHEMA)
    places = posted.where("bucket < 0").select("block", "size", "least", "doc_id", "row", "at_doc", "at_span", "at")
    ranges = cut_tidily(places.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(block_ranges, RANGE_SCHEMA), "byte-ranges")
    drop_cut(posted)
    return ranges


def cut_out(rows: DataFrame) -> DataFrame:
    """doc_id, row, n_removed, n_spans and kept (binary) of (doc_id, row, text, ranges)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ends = [0, *(r["stop"] for r in ranges)]
                kept = b"".join(text[a:z] for a, z in zip(ends, [*(r["start"] for r in ranges), len(text)], strict=True))
                found.append((len(text) - len(kept), len(ranges), kept))
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row", "n_removed", "n_spans", "kept"])

    return rows.select("doc_id", "row", "text", "ranges").mapInArrow(run, "doc_id long, row long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, row, n_bytes, digest), later copies of whole texts (doc_id, row), and what is left of others that
    lose bytes (doc_id, row, n_removed, n_spans, kept)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    every = cut(rows.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")), "byte-documents")
    long_rows = every.where(F.col("n_bytes") >= LENGTH)
    classes = long_rows.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("other")).where("holder < other").drop("other")
    copies = cut(long_rows.join(classes, "digest").where("doc_id > holder").select("doc_id", "row").distinct(), "byte-copies")
    texts = rows.where(F.octet_length("text") >= LENGTH).join(sized_broadcast(copies, 64), ["doc_id", "row"], "left_anti")
    total = every.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = removals(texts, total, hot)
    lost = texts.join(measured_broadcast(ranges, 24 * F.size("ranges")), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    return every, copies, cut_out(lost)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    every, copies, lost = remove_repeats(docs, hot)
    lost = cut_tidily(lost.select("doc_id", "row", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")), "byte-lost")
    joined = every.join(copies.withColumn("gone", F.lit(True)), ["doc_id", "row"], "left").join(lost, ["doc_id", "row"], "left")
    none = F.lit(0).cast("long")
    return joined.select(
        F.when(F.col("doc_id") < NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(F.col("gone"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
