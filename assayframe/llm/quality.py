"""Operator 5: quality rules, lines first.

Each line is judged by rules on its end punctuation, on navigation and on boilerplate. Failing lines are removed; a
document that loses more than MOST_LOST of its words that way is rejected, as is one that fails the base rules.

Edge cases: a null or empty text has no words, all counts are 0 and it fails the base; lines without a word are left
alone and never count as copies; very long texts are read in whole; repeated rows get equal answers; other columns
stay as they are in `judge`. The cleaned text of a document without any kept line is empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.shared import WordHashes, split_words, window_hashes

LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED = 30
#: Share of the words that removed lines may hold.
MOST_LOST = 0.5
SYMBOLS = b"#*$%&|<>"
#: A line of prose ends with one of these, closing quotes and brackets aside.
ENDS = tuple(".!?…:;。！？")
CLOSERS = "\"'”’»)]}* \t\r"
#: Separators of navigation lines.
SEPARATORS = regex.compile(r"[|>»•·/]\s")
BOILERPLATE = regex.compile(
    r"cookie policy|privacy policy|terms of (use|service)|all rights reserved|accept cookies|sign up|log ?in to|subscribe to|click here"
    r"|read more|share (this|on)|copyright ©|©\s*\d{4}|enable javascript|skip to content|back to top|powered by",
    regex.IGNORECASE,
)


def line_failure(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails, or None."""
    if len(words) <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) <= 40 and len(SEPARATORS.findall(line)) >= 2 and not line.rstrip(CLOSERS).endswith("."):
        return "navigation"
    if not line.rstrip(CLOSERS).endswith(ENDS):
        return "punctuation"
    return None


def repeated_words(hashes: np.ndarray, n: int = REPEAT_WINDOW) -> int:
    """Words inside n-word windows that occur twice or more."""
    windows = window_hashes(hashes, n)
    if not len(windows):
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(counts[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None, hashes: WordHashes) -> tuple:
    """Base counts, base verdict, words in removed lines, verdict and cleaned text of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = split_words(text)
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    # A code point has one byte that doesn't continue another.
    chars = sum(map(len, words)) - sum(len(w) - len(w.decode("utf-8", "surrogatepass")) for w in words if not w.isascii())
    repeated = repeated_words(hashes.of(words)) if n > REPEAT_WINDOW else 0
    seen: set[str] = set()
    dup = lost = 0
    kept = []
    for line in (text or "").split("\n"):
        inside = split_words(line)
        if not inside:
            kept.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_failure(line, inside):
            lost += len(inside)
        else:
            kept.append(line)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, chars, n_symbols, dup, repeated, failed, lost, not failed and lost <= MOST_LOST * n, "\n".join(kept)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept", "clean_text"]
KIND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lost long, kept boolean"


def judge(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs with column `quality`: counts, verdicts and, if asked for, the text left after line cleaning."""
    fields = FIELDS if with_text else FIELDS[:-1]

    def run(texts: pd.Series) -> pd.DataFrame:
        hashes = WordHashes()
        rows = [measure(t, hashes) for t in texts]
        return pd.DataFrame([r[: len(fields)] for r in rows], columns=fields)

    kind = KIND + (", clean_text string" if with_text else "")
    return docs.withColumn("quality", F.pandas_udf(run, kind)("text"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "quality.*")
