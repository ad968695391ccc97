"""Operator 7: secret scans by patterns and by dictionary-primed zstandard novelty.

Three patterns find well-formed secrets. Beyond them, strings of letters and digits in a sensitive context are
candidates: each is compressed with a dictionary of identifiers and the text around it. Identifiers are the words that most
documents of the corpus use, counted over all of them, and a short list of common ones. A candidate whose marginal
compressed bytes reach NOVELTY per character repeats nothing known and is reported as `novel`: random strings are stored
byte by byte, while names are made of parts that occur before. Its own copies are left out of the text around it, so a
secret that is printed again and again stays novel; every copy is reported.

Edge cases: a null or empty text has no spans and the digest of the empty string; spans of one kind never overlap;
`novel` spans never overlap those of the patterns; offsets are code points; very long texts are read in whole; equal
counts of words are ordered by code point; an empty table gives no rows and no words.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: A candidate has so many characters at least, not all of them digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"pass|secret|token|key|auth|credential|bearer|private|cert|login|pwd", re.IGNORECASE | re.ASCII)
#: Characters before a candidate that are searched for a sensitive word, and those around it that it is compressed behind.
CONTEXT, AROUND = 48, 2000
#: A reported string adds at least so many bytes per character.
NOVELTY = 0.87
LEAD = b"the file has an authorization token for it: "
#: Words of the corpus that the dictionary takes at most, and characters of each.
DICTIONARY_WORDS, WORD_LENGTH = 3000, (4, 24)
IDENTIFIERS = (
    "self return import function const class public private static string number boolean value default config "
    "username password authorization content-type application/json localhost https:// http:// www. .com index "
    "document window request response session client server database connection timeout version description "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example placeholder changeme undefined null true false"
)


class Novelty:
    """Marginal compressed bytes per character of strings, primed with a dictionary of identifiers and the text around them.

    A string is compressed behind LEAD, short enough that what repeats nothing is stored byte by byte, whatever surrounds it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.identifiers = identifiers.encode() + b" "

    def __call__(self, context: str, candidate: str) -> float:
        known = self.identifiers + context.encode("utf-8", "surrogatepass")
        primer = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=3, dict_data=primer, write_checksum=False, write_content_size=False)
        return (len(z.compress(LEAD + candidate.encode())) - len(z.compress(LEAD))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_of(candidate: str) -> tuple[int, int]:
    """Place of the part behind the last inner `=`, if it is as long as a candidate; else of the whole without padding."""
    end = len(candidate.rstrip("=")) or len(candidate)
    start = candidate.rfind("=", 0, end) + 1
    return (start, end) if end - start >= 16 else (0, end)


def without(text: str, lo: int, hi: int, gone: list[tuple[int, int]]) -> str:
    """text[lo:hi], a space in place of each of the sorted spans."""
    out, k = [], max(0, bisect_left(gone, (lo, 0)) - 1)
    for s, e in gone[k:]:
        if s >= hi:
            break
        if e > lo:
            out.append(text[lo : max(lo, s)])
            lo = e
    return " ".join([*out, text[lo:hi]])


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans of every copy of the candidates whose value is novel where a sensitive word first precedes it."""
    k = 0
    ends = sorted((s, e) for s, _, e in base)
    copies: dict[str, list[tuple[int, int]]] = {}  # places of each value, those in pattern spans too
    spans: dict[str, list[tuple[int, int]]] = {}  # what is reported for it
    asked: dict[str, tuple[int, int]] = {}
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        c = m.group()
        if c.isdigit():
            continue
        a, b = value_of(c)
        value = c[a:b]
        copies.setdefault(value, []).append((s + a, s + b))
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        if any(x < e and s < y for x, y in ends[k : k + 3]):
            continue
        spans.setdefault(value, []).append((s, e))
        if value not in asked and SENSITIVE.search(text, max(0, s - CONTEXT), s):
            asked[value] = s + a, s + b
    out = []
    for value, (s, e) in asked.items():
        around = without(text, max(0, s - AROUND), e + AROUND, copies[value])
        if novelty(around, value) >= NOVELTY:
            out += [(x, 3, y) for x, y in spans[value]]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def corpus_words(docs: DataFrame, most: int = DICTIONARY_WORDS) -> str:
    """The words, in lower case, that most documents have, the most frequent last: a match near the end is the cheapest.

    Parts of names count as words: a capital or any character that isn't a letter begins a new one. A document counts a
    word once, and counts are merged map-side, so what is shuffled is a row per word and task."""
    least, longest = WORD_LENGTH
    apart = F.regexp_replace("text", "([a-z])([A-Z])", "$1 $2")
    words = F.array_distinct(F.filter(F.split(F.lower(apart), "[^a-z]+"), lambda w: F.length(w).between(least, longest)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "word").limit(most).collect()  # DICTIONARY_WORDS rows at most
    return " ".join(r["word"] for r in reversed(top))


KIND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, words: str | None = None) -> DataFrame:
    """docs with column `secrets`: counts per pattern, digest of the pattern spans, and all spans. `words` is the dictionary
    of the corpus, by default that of docs."""
    known = f"{corpus_words(docs) if words is None else words} {IDENTIFIERS}"

    def run(texts: pd.Series) -> pd.DataFrame:
        novelty, rows = Novelty(known), []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            count = [sum(k == i for _, k, _ in base) for i in range(3)]
            every = sorted(base + novel_spans(t, base, novelty))
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.withColumn("secrets", F.pandas_udf(run, KIND)("text"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "secrets.*")
