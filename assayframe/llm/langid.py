"""Operator 10: language identification by interpolated Kneser-Ney character models.

One model per language, each value of `lang` that has a labelled document, trained on a bounded number of its documents;
of these every distinct word counts once a document. Where the tables of all languages would grow too large, languages
are dealt into groups that are learned and scored one after the other. A model reads words: runs of letters in
lower case between word marks, so the probability of a word depends on the word alone and texts are scored by the
words that they hold, each read once per task. Its n-grams are kept as sorted arrays of 64-bit hashes beside their log
probabilities and back-off weights. The language of the lowest cross-entropy per character wins.

Every HELD-th text of the sample is left out of the models and calibrates rejection: from each, pieces of 1, 2, 4, ...
characters are scored, and per language and length the limit is the conformal one: a text is rejected if at most
REJECT_SHARE of the winner's pieces of its length, itself counted, reach its cross-entropy. No margin is added. Where a
length has too few pieces to tell (below 1 / REJECT_SHARE - 1) the next shorter length's limit holds, and a language that
has too few for any rejects nothing. Texts without letters are rejected.

Edge cases: a null or empty text, or one without letters, is `und` with score 0 and rejected; without any labelled text
everything is `und`; a single learned language always wins with score 1; ties go to the first language by code point;
null doc_id counts as the text "" for the hash; repeated rows get equal answers; very long texts are read in whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm.shared import cut, mix64, sized_broadcast

#: Longest n-gram, in characters.
ORDER = 5
#: Per language the sample takes documents in the order of a hash of their text until it has so many. It bounds training, not prediction.
SAMPLE_DOCUMENTS = 1500
#: Of the sample's texts of a language every so many-th is left out of its model and calibrates rejection.
HELD = 4
#: Share of a language's unseen texts that may be rejected.
REJECT_SHARE = 0.01
#: Longest pieces that limits are calibrated for, as a power of two of characters.
LONGEST = 16
#: Languages are learned and scored in groups whose tables hold about so many values (n-grams times languages) at most.
CELLS = 32_000_000
#: Weight of a continuation in absolute discounting.
DISCOUNT = 0.75
#: Words whose scores a task remembers.
REMEMBERED = 150_000

LETTERS = regex.compile(r"\p{L}+")
START, END = "\x02", "\x03"
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def same_length_hash(grams: list[str], n: int) -> np.ndarray:
    """Hashes of n-grams that all have n characters; the empty one has hash 0."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(grams), n)
    h = np.zeros(len(grams), np.uint64)
    for i in range(n):
        h = h * BASE + codes[:, i] + np.uint64(1)
    return mix64(h)


def word_grams(word: str, n: int) -> list[str]:
    """The n-grams that predict each character of the word and its end; shorter at the start."""
    marked = START + word + END
    return [marked[max(0, i - n + 1) : i + 1] for i in range(1, len(marked))]


def top_grams(words: dict[str, int], order: int = ORDER) -> dict[str, int]:
    """Counts of the n-grams that predict each character with the longest context."""
    out: dict[str, int] = {}
    for word, count in words.items():
        for g in word_grams(word, order):
            out[g] = out.get(g, 0) + count
    return out


def kneser_ney(grams: dict[str, int], order: int = ORDER) -> list[tuple[dict[str, float], dict[str, float]]]:
    """For each n-gram length the discounted mass of each n-gram and the back-off weight of each context.

    p(c | context) = mass + weight(context) * p(c | shorter context). The longest n-grams, and those that begin at the
    start of a word, are counted; shorter ones count the distinct characters seen before them.
    """
    counts: list[dict[str, int]] = [{} for _ in range(order + 1)]
    for g, count in grams.items():
        counts[len(g)][g] = count
    for n in range(order, 1, -1):
        for g in counts[n]:
            counts[n - 1][g[1:]] = counts[n - 1].get(g[1:], 0) + 1
    out = []
    for n in range(1, order + 1):
        total: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for g, c in counts[n].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        out.append(({g: (c - DISCOUNT) / total[g[:-1]] for g, c in counts[n].items()}, {k: DISCOUNT * kinds[k] / total[k] for k in total}))
    return out


class Models:
    """The models of all languages in sorted hash arrays: per n-gram length one of n-grams and one of contexts, with a
    column of values for each language (mass 0 and weight 1 where a language has not seen it)."""

    #: An unseen character is one of so many.
    FLOOR = 1.0 / 2**16

    def __init__(self, words: list[dict[str, int]], order: int = ORDER, grams: list[dict[str, int]] | None = None):
        """From each language's counts of words, or of its top_grams."""
        grams = [top_grams(w, order) for w in words] if grams is None else grams
        self.order, self.languages = order, len(grams)
        parts = [kneser_ney(g, order) for g in grams]
        self.mass = [self._table([p[n][0] for p in parts], n + 1, 0.0) for n in range(order)]
        self.weight = [self._table([p[n][1] for p in parts], n, 1.0) for n in range(order)]

    @staticmethod
    def _table(parts: list[dict[str, float]], n: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = list(dict.fromkeys(k for p in parts for k in p))
        values = np.array([[p.get(k, missing) for p in parts] for k in keys], np.float32).reshape(len(keys), len(parts))
        h = same_length_hash(keys, n)
        at = np.argsort(h)
        missing_row = np.full((1, len(parts)), missing, np.float32)
        return h[at], np.concatenate([values[at], missing_row])

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        keys, values = table
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return values[np.where(keys[at] == h, at, len(keys))] if len(keys) else values[np.zeros(len(h), np.int64)]

    def score(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language; the last column is its number of characters, the end included."""
        codes = np.frombuffer((START + (END + START).join(words) + END).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        at = np.arange(len(codes)) - np.repeat(starts, lengths)  # place in the word
        poly = np.zeros(len(codes), np.uint64)
        p = np.full((len(codes), self.languages), self.FLOOR)
        for n in range(self.order):
            before = poly
            poly = np.concatenate([[np.uint64(0)], poly[:-1]]) * BASE + codes + np.uint64(1)
            there = np.flatnonzero(at >= max(n, 1))
            mass = self._look(self.mass[n], mix64(poly[there]))
            weight = self._look(self.weight[n], mix64(before[there - 1]))
            p[there] = mass + weight * p[there]
        bits = -np.log2(p)
        bits[starts] = 0
        return np.concatenate([np.add.reduceat(bits, starts), (lengths - 1)[:, None]], axis=1)


class Scorer:
    """Scores texts under all models; remembers the bits of words it has met."""

    def __init__(self, models: Models, remembered: int = REMEMBERED):
        self.models, self.remembered = models, remembered
        self.row: dict[str, int] = {}
        self.table = np.empty((0, models.languages + 1))

    def words(self, found: list[list[str]]) -> Iterator[np.ndarray]:
        """For each text's words a row of bits under each model and characters."""
        new = list(dict.fromkeys(w for ws in found for w in ws if w not in self.row))
        if len(self.row) + len(new) > self.remembered:
            self.row.clear()
            self.table = self.table[:0]
            new = list(dict.fromkeys(w for ws in found for w in ws))
        if new:
            self.row |= {w: len(self.table) + i for i, w in enumerate(new)}
            parts = [self.models.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *parts])
        look, table = self.row.__getitem__, self.table
        return (table[np.fromiter(map(look, ws), np.int64, len(ws))] for ws in found)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Total bits of each text under each model, and its number of characters; zeros without letters."""
        sums = [rows.sum(axis=0) for rows in self.words([words_of(t) for t in texts])]
        return np.stack(sums) if sums else np.zeros((0, self.models.languages + 1))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that models may learn from: a language, and crc32(doc_id as text) mod 4 other than 2."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of("doc_id") != 2))


def bucket_of(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def lowest_texts(labelled: DataFrame, documents: int) -> DataFrame:
    """lang, h, text and place: each language's distinct texts of the lowest hashes, `documents` of them or all it has.

    Copies count once from the start. Distinct hashes are counted by their first 16 bits, and only those up to the range
    in which the count reaches `documents` are ordered.
    """
    distinct = cut(labelled.select("lang", "h").distinct().withColumn("range", F.shiftrightunsigned("h", 48)), "langid-hashes")
    ranges = distinct.groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("lang").orderBy("range")) - F.col("n")
    ranges = ranges.withColumn("before", before).where(F.col("before") < documents)
    last = F.broadcast(ranges.groupBy("lang").agg(F.max("range").alias("last")))
    place = F.row_number().over(W.partitionBy("lang").orderBy("range", "h"))
    low = distinct.join(last, "lang").where(F.col("range") <= F.col("last")).withColumn("place", place)
    low = sized_broadcast(cut(low.where(F.col("place") <= documents).select("lang", "h", "place"), "langid-lowest"), 48)
    return labelled.join(low, ["lang", "h"]).groupBy("lang", "h", "place").agg(F.min("text").alias("text"))


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, cells: int = CELLS) -> dict:
    """Languages and rejection limits as plain values, and for each group of languages a broadcast of its models.

    The sample holds at most `documents` texts per language. The driver holds the models of one group at a time.
    """
    spark = docs.sparkSession
    labelled = learnable(docs).select("lang", "text", F.xxhash64("text").alias("h"))
    picked = cut(lowest_texts(labelled, documents), "langid-sample")
    grams = picked.where(F.col("place") % HELD != 0).mapInPandas(_grams, "lang string, gram string, n long")
    grams = cut(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    sizes = sorted((r["lang"], r["count"]) for r in grams.groupBy("lang").count().collect())  # a row a language
    groups = grouped(sizes, cells)
    models = []
    for group in groups:
        rows = grams.where(F.col("lang").isin(group)).toPandas()  # bounded by the group's size
        by_lang = {lang: dict(zip(own["gram"], own["n"].astype(int), strict=True)) for lang, own in rows.groupby("lang")}
        models.append(spark.sparkContext.broadcast(Models([], grams=[by_lang[x] for x in group])))
        del rows, by_lang
    langs = [x for group in groups for x in group]
    if not langs:
        return {"languages": [], "groups": [], "models": [], "limits": []}

    def pieces_of(sent):
        def pieces(frames):
            scorer = Scorer(sent.value)
            for f in frames:
                out = []
                found = [turned(words_of(t), h) for t, h in zip(f["text"], f["h"], strict=True)]
                for lang, h, rows in zip(f["lang"], f["h"], scorer.words(found), strict=True):
                    sums = rows.cumsum(axis=0)
                    for size in range(LONGEST + 1):
                        at = np.searchsorted(sums[:, -1], 1 << size)
                        if at == len(sums):
                            break
                        out.append((lang, h, size, float(sums[at, :-1].min() / sums[at, -1])))
                yield pd.DataFrame(out, columns=["lang", "h", "size", "best"])

        return pieces

    held = picked.where(F.col("place") % HELD == 0).select("lang", "h", "text")
    found = [cut(held.mapInPandas(pieces_of(m), "lang string, h long, size int, best double"), "langid-pieces") for m in models]
    best = reduce(DataFrame.union, found).groupBy("lang", "h", "size").agg(F.min("best").alias("best"))
    best = best.groupBy("lang", "size").agg(F.sort_array(F.collect_list("best"), asc=False).alias("best"))  # at most documents / HELD a list
    # Of a list only the value at the limit's place leaves its task.
    k = F.floor(F.lit(REJECT_SHARE) * (F.size("best") + 1)).cast("int")
    by = {(r["lang"], r["size"]): r["limit"] for r in best.where(k > 0).select("lang", "size", F.element_at("best", k).alias("limit")).collect()}
    return {"languages": langs, "groups": groups, "models": models, "limits": [limits_of([by.get((x, i)) for i in range(LONGEST + 1)]) for x in langs]}


def grouped(sizes: list[tuple[str, int]], cells: int) -> list[list[str]]:
    """Languages in order, a new group wherever n-grams times languages would exceed `cells`; one at least in each."""
    out, total = [], 0
    for lang, n in sizes:
        if not out or (total + n) * (len(out[-1]) + 1) > cells:
            out.append([])
            total = 0
        out[-1].append(lang)
        total += n
    return out


def turned(words: list[str], h: int) -> list[str]:
    """The words from a place on that depends on h, then those before it, so that pieces don't all begin as texts do."""
    at = h % len(words) if words else 0
    return words[at:] + words[:at]


def limits_of(found: list[float | None]) -> list[float]:
    """Highest cross-entropy that isn't rejected, by length; where there is none, that of the next shorter length."""
    out = []
    for x in found:
        out.append(x if x is not None else out[-1] if out else math.inf)
    return out


def _grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        counts: dict[str, dict[str, int]] = {}
        for lang, text in zip(f["lang"], f["text"], strict=True):
            own = counts.setdefault(lang, {})
            for w in set(words_of(text)):
                own[w] = own.get(w, 0) + 1
        for lang, own in counts.items():
            grams = top_grams(own)
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


def identify(docs: DataFrame, learned: dict) -> DataFrame:
    """docs with lang_pred, score, bits (per character) and rejected; columns of these names are replaced, others stay.

    The score is the winner's share among exp(-bits) of all languages over up to 200 characters' worth of evidence.
    """
    names, groups = learned["languages"], learned["groups"]
    limits = np.array(learned["limits"]).reshape(len(names), LONGEST + 1)
    final = "lang_pred string, score double, bits double, rejected boolean"
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "bits", "rejected", "_guess")]
    if not names:
        none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(float("nan")).alias("bits"), F.lit(True).alias("rejected"))
        return docs.withColumn("_guess", none).select(*own, "_guess.*")

    def guess_of(i: int):
        """Scores group i; joins it to what earlier groups gave (winner, its bits, odds against it), and ends at the last."""
        sent, before, state = learned["models"][i], sum(map(len, groups[:i])), {}

        def guess(texts: pd.Series, earlier: pd.DataFrame | None = None) -> pd.DataFrame:
            n = len(texts)
            if "scorer" not in state:
                state["scorer"] = Scorer(sent.value)
            parts, some, size = [], [], 0
            for t in texts:  # about a million characters at a time
                some.append(t or "")
                size += len(some[-1])
                if size > 1_000_000:
                    parts.append(state["scorer"].texts(some))
                    some, size = [], 0
            parts.append(state["scorer"].texts(some))
            bits = np.concatenate(parts)
            chars = bits[:, -1]
            evidence = np.minimum(chars, 200)
            per = bits[:, :-1] / np.maximum(chars, 1)[:, None]
            best = per.argmin(axis=1)
            low = per[np.arange(n), best]
            odds = np.exp2(-(per - low[:, None]) * evidence[:, None]).sum(axis=1)
            best = best + before
            if earlier is not None:
                was = earlier["low"].to_numpy()
                least = np.minimum(was, low)
                odds = odds * np.exp2((least - low) * evidence) + earlier["odds"].to_numpy() * np.exp2((least - was) * evidence)
                best, low = np.where(was <= low, earlier["best"].to_numpy(), best), least
            if i + 1 < len(groups):
                return pd.DataFrame({"best": best, "low": low, "odds": odds})
            there = chars > 0
            size = np.minimum(np.log2(np.maximum(chars, 1)).astype(np.int64), LONGEST)
            return pd.DataFrame({
                "lang_pred": np.where(there, np.array(names, object)[best], "und"),
                "score": np.where(there, 1 / odds, 0.0),
                "bits": np.where(there, low, np.nan),
                "rejected": ~there | (low > limits[best, size]),
            })

        if i == 0:
            def first(texts: pd.Series) -> pd.DataFrame:
                return guess(texts)

            return first

        def later(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
            return guess(texts, earlier)

        return later

    out = docs
    for i in range(len(groups)):
        kind = final if i + 1 == len(groups) else "best long, low double, odds double"
        # Each group's pass is written, so no task holds the models of two.
        out = (cut(out, "langid-group") if i else out).withColumn("_guess", F.pandas_udf(guess_of(i), kind)("text", *["_guess"] * (i > 0)))
    return out.select(*own, "_guess.*")


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (bucket_of("doc_id") == 2).alias("held_out"), "lang_pred", "score", "rejected", "bits")
