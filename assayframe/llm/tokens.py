"""Operator 6: token ids in binary shards, compressed by Re-Pair grammars.

Documents are ordered by id over range partitions. Each task encodes its texts word by word (white space parts words in
this tokenizer, and words part into pieces, so a text's ids are those of its pieces in order, and a piece that is remembered
is encoded once per task), ends every document with END_ID and closes a shard at SHARD_TOKENS ids.

A shard is one file: a header, the rules of its grammar (two symbols each), the expansion length of each rule, the
compressed symbols, and per document its id, first symbol and first token in the shard. Rules never reach over the end of
a document, so any document is decoded alone: read its symbols and expand the rules. Symbols are stored in planes: a bit
that tells rules from tokens, the low 16 bits of the number of either, and the high ones only where some number has them.

Edge cases: a null or empty text is its end id alone; equal doc_ids stay in the order of their texts' hashes; a null
doc_id comes first and has a flag of its own; a document longer than a shard is a shard of its own; an empty table writes no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm.shared import BATCH_BYTES, cut, open_store, released, setting, work_path

END_ID = 2
SHARD_TOKENS = 1 << 20
MAGIC = b"AFRP0002"
HEADER = struct.Struct("<8sIIQQ")
#: Pairs that occur less often than this get no rule.
LEAST_PAIRS = 16
#: First nonterminal; above any id of the public tokenizers.
FIRST_RULE = 1 << 20
#: Pieces of words that a worker remembers.
REMEMBERED = 250_000
#: Bytes of text that are encoded together, one text at least; a task holds a few times as much beside its shard.
ENCODE_BYTES = 4 << 20
#: Pairs are counted roughly in so many bins (a power of two) before they are counted exactly.
PAIR_BITS = 17
ODD, OTHER_ODD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# How this tokenizer parts words into pieces, for texts of ASCII and the letters of Latin-1, in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n")
#: A line with anything else, or with the signs of special tokens, goes through the whole tokenizer.
OTHER = re.compile(r"^[!-;=?-{}~À-ÖØ-öø-ÿ]*[^\n!-;=?-{}~À-ÖØ-öø-ÿ].*$", re.MULTILINE)
#: Byte-level names of bytes: themselves where Latin-1 prints them, else the code points from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_NAMES = {b: b if b in PRINTED else 256 + sum(x not in PRINTED for x in range(b)) for b in range(256)}


class Pieces:
    """Ids of named pieces, one behind the other in `flat`; `row` numbers the names."""

    def __init__(self) -> None:
        """Row 0 stays: nothing. The end of a word has no row."""
        self.row: dict[str, int] = {"": 0, "\n": -1}
        self.sizes, self.flat = array("q", [0]), array("I")

    def add(self, name: str, ids: list[int]) -> int:
        row = self.row[name] = len(self.sizes)
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return row


def gathered(rows: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each row, and the ids of all rows behind each other."""
    size, begin = sizes[rows], np.cumsum(sizes) - sizes
    upto = np.cumsum(size)
    return size, flat[np.repeat(begin[rows] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Ids of texts. Arrow splits a batch of texts at ASCII white space and names its distinct words; these are parted into
    pieces by one pass of a pattern, and pieces that haven't been met are encoded by the tokenizer's model. The ids of all
    words are then gathered from arrays."""

    def __init__(self, path: str):
        # Tasks are Spark's unit of work: threads of the library's own would only compete with other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = Pieces()

    def piece(self, name: str) -> int:
        """The row of a piece."""
        if (found := self.pieces.row.get(name)) is not None:
            return found
        spelled = name if name.isascii() else name.encode().decode("latin-1").translate(BYTE_NAMES)
        return self.pieces.add(name, [t.id for t in self.model.tokenize(spelled)])

    def word(self, word: str) -> int:
        """The row of a word that goes through the whole tokenizer; its name, behind a line feed, is no piece's."""
        found = self.pieces.row.get("\n" + word)
        return self.pieces.add("\n" + word, self.tokenizer.encode(word, add_special_tokens=False).ids) if found is None else found

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of the distinct words, and the ids."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        if len(self.pieces.row) > REMEMBERED:
            self.pieces = Pieces()
        # One string instead of one a word; no word holds a line feed.
        row, lines = self.pieces.row, pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\n")[0].as_py()
        if others := OTHER.findall(lines):
            # Their stand-ins are two characters for private use, which only stand in such words themselves.
            names = {w: chr(0xE000 + (i >> 12)) + chr(0xE000 + (i & 4095)) for i, w in enumerate(others)}
            row.update((n, self.word(w)) for w, n in names.items())
            lines = "\n".join([names.get(w, w) for w in lines.split("\n")])
        found = PIECE.findall(lines.lower())
        rows = np.fromiter(map(row.get, found, repeat(-2)), np.int64, len(found))
        for i in np.flatnonzero(rows == -2).tolist():
            rows[i] = self.piece(found[i])
        mark = rows < 0  # the ends of words
        rows[mark] = 0
        size, ids = gathered(rows, np.frombuffer(self.pieces.sizes, np.int64), np.frombuffer(self.pieces.flat, np.uint32))
        return np.bincount(np.cumsum(mark), weights=size, minlength=len(words)).astype(np.int64), ids

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (nulls are empty), its end id last."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        named = split.flatten().dictionary_encode()
        sizes, flat = self.words(named.dictionary)
        # One more row: the end of a document.
        sizes, flat = np.append(sizes, 1), np.append(flat, np.uint32(END_ID))
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n_words)
        word = np.insert(named.indices.to_numpy().astype(np.int64), ends, len(sizes) - 1)
        size, ids = gathered(word, sizes, flat)
        return np.split(ids, np.cumsum(size)[ends + np.arange(len(ends))][:-1]) if len(ends) else []


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker: tasks that run in it one after the other share its pieces."""
    return Encoder(path)


def re_pair(ids: np.ndarray, last: np.ndarray, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (rows of two symbols) and document ends among the symbols.

    Each round counts the adjacent pairs and gives a rule to all that occur `least` times. Where chosen pairs overlap the
    more frequent one is replaced, and the leftmost of a run; a rule that is left with too few places is dropped.
    """
    sym, rules, n_rules = ids.astype(np.uint32), [], 0
    none = 1 << PAIR_BITS  # bin of pairs that reach over a document's end
    while len(sym) > 1:
        # Counts of hashed pairs are never too small, so only pairs that may reach the bound need to be sorted.
        bins = (sym[:-1] * ODD ^ sym[1:] * OTHER_ODD) >> np.uint32(32 - PAIR_BITS)
        bins[last[:-1]] = none
        rough = np.bincount(bins, minlength=none + 1)
        rough[none] = 0
        most = int(rough.max())
        # Only the upper part of the pairs each round, so that frequent pairs come first as in one-by-one replacement.
        while True:
            bound = max(least, most // 16)
            at = np.flatnonzero((rough >= bound)[bins])
            kinds, back, counts = np.unique(sym[at].astype(np.uint64) << np.uint64(32) | sym[at + 1], return_inverse=True, return_counts=True)
            if bound == least or (len(counts) and counts.max() >= bound):
                break
            most = bound
        if not len(counts) or counts.max() < least:
            break
        rank = np.zeros(len(kinds), np.int64)  # of chosen pairs; 0 for none
        good = np.flatnonzero(counts >= bound)
        rank[good[np.argsort(counts[good], kind="stable")]] = np.arange(1, len(good) + 1)
        score = rank[back]
        at, score = at[score > 0], score[score > 0]
        beside = np.diff(at) == 1
        before = np.concatenate([[0], np.where(beside, score[:-1], 0)])
        after = np.append(np.where(beside, score[1:], 0), 0)
        take = (score > before) & (score >= after)
        at, name = at[take], score[take]
        used, new, n = np.unique(name, return_inverse=True, return_counts=True)
        worth = n >= max(2, least // 2)
        if not worth.any():
            break
        number = np.cumsum(worth) - 1
        by_rank = np.zeros(len(good) + 1, np.uint64)
        by_rank[rank[good]] = kinds[good]
        pairs = by_rank[used[worth]]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1))
        ok = worth[new]
        at = at[ok]
        sym[at] = FIRST_RULE + n_rules + number[new[ok]]
        last[at] = last[at + 1]
        n_rules += int(worth.sum())
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, last = sym[keep], last[keep]
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint64)
    return sym, table.astype(np.uint32), last


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Tokens that each rule stands for; a rule only uses earlier ones."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - FIRST_RULE] if a >= FIRST_RULE else 1) + (out[b - FIRST_RULE] if b >= FIRST_RULE else 1))
    return np.array(out, np.uint32)


def planes(symbols: np.ndarray) -> bytes:
    """Symbols as stored."""
    rule = symbols >= FIRST_RULE
    number = symbols - rule * np.uint32(FIRST_RULE)
    wide = bool(len(number)) and int(number.max()) > 0xFFFF
    high = (number >> np.uint32(16)).astype(np.uint16).tobytes() if wide else b""
    return bytes([wide]) + np.packbits(rule).tobytes() + number.astype(np.uint16).tobytes() + high


def pack(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    """A shard's file."""
    ids = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, rules, last = re_pair(ids, last)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype(np.uint64)
    start = np.concatenate([[0], ends[:-1]]).astype(np.uint64)
    return b"".join([
        HEADER.pack(MAGIC, FIRST_RULE, len(rules), len(symbols), len(parts)),
        planes(rules.ravel()), expansion_lengths(rules).tobytes(), planes(symbols),
        np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        first.tobytes(), start.tobytes(), np.array([len(ids)], np.uint64).tobytes(),
    ])


class Shard:
    """A shard's file, opened; documents are decoded one by one."""

    def __init__(self, data: bytes):
        self.flat = None
        magic, self.base, n_rules, n_symbols, n_docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token shard")
        at = HEADER.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def symbols(n):
            wide = take(np.uint8, 1)[0]
            rule = np.unpackbits(take(np.uint8, -(-n // 8)), count=n)
            out = take(np.uint16, n).astype(np.uint32)
            if wide:
                out |= take(np.uint16, n).astype(np.uint32) << np.uint32(16)
            return out + rule * np.uint32(self.base)

        self.rules, self.lengths = symbols(2 * n_rules).reshape(-1, 2), take(np.uint32, n_rules)
        self.symbols = symbols(n_symbols)
        ids, null = take(np.int64, n_docs), take(np.uint8, n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.first = np.append(take(np.uint64, n_docs), n_symbols).astype(np.int64)
        self.start = np.append(take(np.uint64, n_docs), take(np.uint64, 1)).astype(np.int64)

    def expand(self, sym: np.ndarray) -> np.ndarray:
        """All tokens of symbols; what each rule stands for is written out once."""
        if self.flat is None:
            parts: list[np.ndarray] = []
            for pair in self.rules.tolist():
                parts.append(np.concatenate([parts[x - self.base] if x >= self.base else np.array([x], np.uint32) for x in pair]))
            self.flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            self.offset = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        at = np.flatnonzero(sym >= self.base)
        rule = sym[at] - self.base
        size = np.ones(len(sym), np.int64)
        size[at] = n = self.lengths[rule].astype(np.int64)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[first] = sym
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(first[at], n) + step] = self.flat[np.repeat(self.offset[rule], n) + step]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])

    def token(self, k: int, i: int) -> int:
        """The i-th token of document k: expansion lengths tell which symbol to open."""
        for s in self.symbols[self.first[k] : self.first[k + 1]].tolist():
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if i < n:
                while s >= self.base:
                    a, b = self.rules[s - self.base].tolist()
                    left = 1 if a < self.base else int(self.lengths[a - self.base])
                    s, i = (a, i) if i < left else (b, i - left)
                return s
            i -= n
        raise IndexError(i)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings in a column have about `most` bytes together, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(size) // most
    edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


INDEX = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, most: int = SHARD_TOKENS) -> DataFrame:
    """Writes docs (doc_id, text) in order of doc_id; returns the index of shards with each one's first global token.

    Only shards that the index names count, so files of lost or repeated tasks are never read.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        encode, ids, parts, size, seq = encoder(tokenizer), [], [], 0, 0

        def close(part):
            nonlocal ids, parts, size, seq
            name = f"{uuid.uuid4().hex}.rp"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(pack(ids, parts))
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, name, size, len(ids)), INDEX.types, strict=True)], schema=INDEX)
            ids, parts, size, seq = [], [], 0, seq + 1
            return row

        part = 0
        for batch in released(batches):
            for some in by_bytes(batch, 2, ENCODE_BYTES):
                part = some.column(0)[0].as_py()
                for d, t in zip(some.column(1).to_pylist(), encode(some.column(2)), strict=True):
                    if parts and size + len(t) > most:
                        yield close(part)
                    ids.append(d)
                    parts.append(t)
                    size += len(t)
        if parts:
            yield close(part)

    # A task's texts would be one batch otherwise, beside the shard.
    with setting(spark, BATCH_BYTES, str(ENCODE_BYTES)):
        index = cut(ordered.mapInArrow(write, "part int, seq long, file string, n_tokens long, n_docs long"), "token-index")
    # A row a part is summed up in order, then the shards inside each part.
    zero = F.lit(0).cast("long")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), zero).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), zero)
    return cut(index.withColumn("inside", inside).join(parts, "part").select("file", (F.col("before") + F.col("inside")).alias("shard_start"), "n_tokens", "n_docs"), "token-starts")


def read_shards(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{file}", compression=None) as f:
                    shard = Shard(f.read())
                ids = shard.expand(shard.symbols)
                rows = []
                for k, doc_id in enumerate(shard.doc_ids):
                    own = ids[shard.start[k] : shard.start[k + 1]]
                    rows.append((doc_id, at + int(shard.start[k]), len(own), zlib.crc32(own.astype("<u4").tobytes()), own)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # Index rows are few bytes each; a stated number of partitions keeps Spark from putting all shards into one task.
    n = max(1, min(index.count(), 20_000))
    return index.select("file", "shard_start").repartition(n, F.col("file")).mapInArrow(read, kind)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    folder = work_path(docs.sparkSession, "tokens")
    index = write_shards(docs, folder, tokenizer or public_tokenizer())
    return read_shards(index, folder, with_ids)


def op6_token_binary(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
