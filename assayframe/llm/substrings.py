"""Operator 9: substring dedup by recompression.

Rounds of recompression turn a document's words into symbols: short runs of one word get a name, then adjacent pairs whose
names fall left and right of a hash bit. Names are hashes of their parts, so the same run or pair has the same name
everywhere without a table. Whether two symbols join depends on these two alone, and a round's symbols span no more words
than LIMITS says, so equal windows of WINDOW words have the same symbols but for EDGE words at either end.

Every window picks one interior symbol, the longest and then the one of least name, and windows that follow each other
and pick the same symbol form a span. A span is posted under the words around its symbol that all its windows share.
Keys alone are counted first, and only spans whose key occurs again move on. Documents that share a key are revealed;
equal spans verify all their windows at once. Where spans of a key differ, one holder of each posts its windows, and
those are matched by themselves. So copies cost a row per span, not pairs. The texts of documents with something to
match or to remove are set apart once, and later steps read those only.

Documents of equal word sequences form a class first, and only its smallest doc_id is posted.

Edge cases: null, empty and blank texts have no words; texts shorter than a window lose nothing and are never a source
of removal; equal doc_ids never remove each other; a null doc_id counts as above all others and loses what others have;
very long texts are read in whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.shared import WordHashes, cut, drop_cut, measured_broadcast, mix64, sized_broadcast, split_words, window_hashes

WINDOW = 50
#: Most words of a run's symbol, then of a pair's symbol in each round. A round blurs at most the longest symbol before
#: it at either end of a window, 3 + 3 + 4 + 5 words in all.
RUN_LIMIT = 3
LIMITS = (4, 5, 8)
EDGE = 15
#: Symbol starts that a window may pick from: every LIMITS[-1] words have one, and a whole symbol fits before the far edge.
CHOICE = WINDOW - 2 * EDGE - LIMITS[-1] + 1
NULL_ID = 2**63 - 1


def recompress(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length in words and name of each symbol of the last round."""
    n = len(words)
    edge = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    length = np.diff(np.append(edge, n))
    with np.errstate(over="ignore"):
        # Runs of two or three words become symbols; longer ones stay as they are.
        short = length <= RUN_LIMIT
        keep = np.repeat(~short, length)
        keep[edge] = True
        start = np.flatnonzero(keep)
        size = np.diff(np.append(start, n))
        name = np.where(size > 1, mix64(words[start] * np.uint64(2 * RUN_LIMIT + 1) + size.astype(np.uint64)), words[start])
        for r, most in enumerate(LIMITS):
            if len(name) < 2:
                break
            side = (mix64(name + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
            join = np.append(side[:-1] & ~side[1:] & (size[:-1] + size[1:] <= most), False)
            after = np.concatenate([[False], join[:-1]])
            at = np.flatnonzero(join)
            name, size = name.copy(), size.copy()
            name[at] = mix64(name[at] * np.uint64(0x9E3779B97F4A7C15) + name[at + 1] + np.uint64(r))
            size[at] += size[at + 1]
            start, size, name = start[~after], size[~after], name[~after]
    return start, size, name


def spans(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, span hash and place (packed: first window start, further windows, words from there to the symbol) of each span of
    a document of WINDOW words or more."""
    n_windows = len(words) - WINDOW + 1
    start, size, name = recompress(words)
    rank = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    rank[start] = (np.uint64(LIMITS[-1]) - size.astype(np.uint64) << np.uint64(59)) | (name >> np.uint64(5))
    view = np.lib.stride_tricks.sliding_window_view(rank[EDGE : EDGE + n_windows + CHOICE - 1], CHOICE)
    pick = np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, n_windows, 65536)]) + np.arange(n_windows) + EDGE
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    last = np.append(first[1:], n_windows) - 1
    at = pick[first]
    # All windows that may pick a symbol at `at` hold the words from at - EDGE to the common end.
    common = WINDOW - (CHOICE - 1)
    key = window_hashes(words, common)[at - EDGE]
    # Polynomial prefix sums give the hash of a span of any length.
    with np.errstate(over="ignore"):
        whole = window_hashes(words, WINDOW)
        lead = (at - first).astype(np.uint64)
        more = (last - first).astype(np.uint64)
        full = mix64(whole[first] + np.uint64(3) * mix64(whole[last] + np.uint64(1)) + (more * np.uint64(WINDOW) + lead) * np.uint64(0x9E3779B97F4A7C15))
    return key, full, (first << 16) | (last - first << 8) | (at - first)


def document_keys(rows: DataFrame) -> DataFrame:
    """doc_id, row, n_words and the SHA-256 of the words joined by spaces. rows: doc_id, row, text."""

    def run(batches):
        for batch in batches:
            split = [split_words(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, split), pa.int64()), pa.array((hashlib.sha256(b" ".join(ws)).hexdigest() for ws in split), pa.string())],
                names=["doc_id", "row", "n_words", "digest"],
            )

    return rows.mapInArrow(run, "doc_id long, row long, n_words long, digest string")


NAMES = ["doc_id", "row", "key", "span", "place"]
FIRST, LAST = "shiftright(place, 16)", "shiftright(place, 16) + (shiftright(place, 8) & 255)"


def post_spans(rows: DataFrame) -> DataFrame:
    """A row of NAMES for each span of (doc_id, row, text)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                out = []
                for doc_id, row, t in zip(*[c.to_pylist() for c in batch.slice(lo, 128).columns], strict=True):
                    ws = split_words(t)
                    if len(ws) >= WINDOW:
                        key, full, place = spans(hashes.of(ws))
                        out.append((np.full(len(key), doc_id, np.int64), np.full(len(key), row, np.int64), key.view(np.int64), full.view(np.int64), place))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in NAMES))


def post_windows(rows: DataFrame) -> DataFrame:
    """Key, hash and place of each window of the listed spans. rows: doc_id, row, text, listed (key, first, last)."""
    names = ["doc_id", "row", "key", "window", "at"]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for doc_id, row, t, listed in zip(*[c.to_pylist() for c in batch.slice(lo, 256).columns], strict=True):
                    whole = window_hashes(hashes.of(split_words(t)), WINDOW).view(np.int64)
                    at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in listed])
                    key = np.repeat([s["key"] for s in listed], [s["last"] - s["first"] + 1 for s in listed])
                    out.append((np.full(len(at), doc_id, np.int64), np.full(len(at), row, np.int64), key, whole[at], at))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.select("doc_id", "row", "text", "listed").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def removals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, ranges of window starts) that also occur in a smaller doc_id, and the texts of such rows, among others.
    rows: doc_id, row, text."""
    posted = cut(post_spans(rows), "sub-spans")
    again = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = cut(posted.join(again, "key", "left_semi"), "sub-kept")
    drop_cut(posted)
    # A row per different span first: what follows is about those, however many documents hold each.
    held = kept.groupBy("key", "span").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("other"))
    held = cut(held, "sub-held")
    per_key = held.groupBy("key").agg(F.count("*").alias("kinds"), F.min("holder").alias("lo"), F.max("other").alias("hi")).where("lo < hi")
    shared = held.join(per_key.select("key", "kinds"), "key").where("kinds > 1 or holder < other").select("key", "span", "holder", "kinds")
    # Later holders of a span lose it; of a key with several spans one holder of each posts its windows.
    met = kept.join(shared, ["key", "span"]).where("doc_id > holder or kinds > 1")
    met = cut(met.select("doc_id", "row", "key", F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"), (F.col("doc_id") > F.col("holder")).alias("later")), "sub-met")
    drop_cut(kept)
    drop_cut(held)
    involved = cut(met.select("doc_id", "row").distinct(), "sub-involved")
    texts = cut(rows.join(sized_broadcast(involved, 24), ["doc_id", "row"], "left_semi"), "sub-texts")

    asked = met.where("not later").select("doc_id", "row", "key", "first", "last").distinct()
    asked = cut(asked.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "first", "last")).alias("listed")), "sub-asked")
    windows = cut(post_windows(texts.join(list_side(asked, "listed"), ["doc_id", "row"])), "sub-windows")
    least = windows.groupBy("key", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    single = windows.join(least, ["key", "window"]).where("doc_id > least").select("doc_id", "row", F.col("at").alias("first"), F.col("at").alias("last"))
    # A document's list is bounded by its length.
    equal = met.where("later").select("doc_id", "row", "first", "last")
    ranges = cut(equal.union(single).groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "sub-ranges")
    drop_cut(windows)
    return ranges, texts


def list_side(df: DataFrame, column: str) -> DataFrame:
    """df (already cut) with a broadcast hint if its rows and list items, counted, fit the limit."""
    return measured_broadcast(df, 32 * F.size(column))


def removed_words(n: int, ranges: list) -> np.ndarray:
    """Whether each of n words is covered by a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    for r in ranges:
        edge[r["first"]] += 1
        edge[r["last"] + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut_out(rows: DataFrame) -> DataFrame:
    """doc_id, row, n_removed and kept_text of (doc_id, row, text, ranges)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, row, t, ranges in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ws = split_words(t)
                gone = removed_words(len(ws), ranges)
                out.append((doc_id, row, int(gone.sum()), b" ".join(ws[i] for i in np.flatnonzero(~gone)).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["doc_id", "row", "n_removed", "kept_text"])

    return rows.select("doc_id", "row", "text", "ranges").mapInArrow(run, "doc_id long, row long, n_removed long, kept_text string")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id (NULL_ID for null), row (a hash of the text, which tells texts of one doc_id apart) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def changed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, row, n_words, digest), later copies of whole texts (doc_id, row), and rows that lose words
    otherwise (doc_id, row, n_removed, kept_text)."""
    rows = keyed_rows(docs)
    every = cut(document_keys(rows), "sub-documents")
    long_rows = every.where(F.col("n_words") >= WINDOW)
    classes = long_rows.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("other")).where("holder < other").drop("other")
    copies = cut(long_rows.join(classes, "digest").where("doc_id > holder").select("doc_id", "row").distinct(), "sub-copies")
    texts = rows.join(sized_broadcast(copies, 64), ["doc_id", "row"], "left_anti")
    ranges, some = removals(texts)
    lost = cut_out(some.join(list_side(ranges, "ranges"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]))
    return every, copies, lost


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    every, copies, lost = changed(docs)
    lost = cut(lost.select("doc_id", "row", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept")), "sub-lost")
    gone = copies.select("doc_id", "row", F.lit(True).alias("gone"))
    joined = every.join(gone, ["doc_id", "row"], "left").join(lost, ["doc_id", "row"], "left")
    return joined.select(
        F.when(F.col("doc_id") < NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("gone"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
