"""Operator 3: benchmark decontamination over a positional inverted index, with built-in functions only.

A benchmark window is WINDOW consecutive words of an item, or all words of a shorter one. The number of times that each
benchmark term occurs in the corpus gives every window its ANCHORS rarest places. The index stores the postings
(document, position) of those terms only. Lists are intersected from the rarest term on, each shifted by its offset in the
window; the few places that remain are compared with the window's whole phrase. With a slop the shifted lists may miss
each other by some words, which gives proximity matches.

Benchmark tables are broadcast only if their counted size fits; beyond it Spark joins them by shuffle.

Edge cases: null, empty and blank texts have no words and no hits, and items without words no windows; windows that
several items share count for each; repeated rows get equal answers; a null doc_id or item_id is an id like any other
(a null item_id counts, but isn't in the joined ids); very long texts are read in whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm.shared import cut, lower_ascii, measured_broadcast, sized_broadcast

WINDOW = 13
ANCHORS = 3
#: A document is contaminated if one in so many of its words is hit.
HIT_PART = 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: str) -> Column:
    """Words of the column of that name, A-Z in lower case; empty for null. Texts in ASCII take the faster lower()."""
    c = F.col(text)
    low = F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(lower_ascii(c))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def benchmark_windows(bench: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, phrase, len), and the items of each (wid, item)."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), terms("text").alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (n - 1)))
    every = items.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), n).alias("phrase"))
    every = cut(every.withColumn("wid", F.sha1(F.concat_ws(" ", "phrase").cast("binary"))), "decon-windows")
    windows = every.select("wid", "phrase", F.size("phrase").alias("len")).dropDuplicates(["wid"])
    return cut(windows, "decon-phrases"), cut(every.select("wid", "item").distinct(), "decon-items")


def rare_anchors(corpus: DataFrame, windows: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(wid, len, rank, term, off): the k places of each window whose terms are rarest in the corpus (key, ws)."""
    places = windows.select("wid", "len", F.posexplode("phrase").alias("off", "term"))
    vocabulary = sized_broadcast(cut(places.select("term").distinct(), "decon-terms"), 64)
    counts = corpus.select(F.explode("ws").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = sized_broadcast(cut(counts, "decon-counts"), 64)
    rarest = F.row_number().over(W.partitionBy("wid").orderBy("n", "term", "off"))
    known = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    # A term that the corpus lacks rules the window out.
    ranked = known.withColumn("rank", rarest).withColumn("least", F.min("n").over(W.partitionBy("wid")))
    return cut(ranked.where((F.col("rank") <= k) & (F.col("least") > 0)).select("wid", "len", "rank", "term", "off"), "decon-anchors")


def index_postings(corpus: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, pos, term) of every place where the corpus has a term of the anchors."""
    wanted = sized_broadcast(cut(anchors.select("term").distinct(), "decon-wanted"), 64)
    return cut(corpus.select("key", F.posexplode("ws").alias("pos", "term")).join(wanted, "term").select("key", "pos", "term"), "decon-postings")


def intersect(postings: DataFrame, anchors: DataFrame, k: int = ANCHORS, slop: int = 0) -> DataFrame:
    """Distinct (key, wid, start, len) where all anchors of a window occur, shifted by at most slop."""

    def ranked(rank: int) -> DataFrame:
        own = anchors.where(F.col("rank") == rank)
        return own.select("wid", "len", F.col("off").alias("o"), F.col("term").alias("t"))

    first = sized_broadcast(cut(ranked(1), "decon-first"), 128)
    found = postings.join(first, postings["term"] == first["t"]).select("key", "wid", "len", (F.col("pos") - F.col("o")).alias("start"))
    found = found.where("start >= 0") if not slop else found
    for rank in range(2, k + 1):
        own = sized_broadcast(cut(ranked(rank), "decon-next").drop("len"), 128)
        # Windows shorter than the rank have no such anchor and pass.
        asked = found.join(own, "wid", "left").withColumn("p", F.explode(F.sequence(F.col("start") + F.coalesce("o", F.lit(0)) - slop, F.col("start") + F.coalesce("o", F.lit(0)) + slop)))
        met = asked.where("t is not null").join(
            postings.select(F.col("key").alias("pk"), F.col("pos").alias("pp"), F.col("term").alias("pt")),
            (F.col("key") == F.col("pk")) & (F.col("p") == F.col("pp")) & (F.col("t") == F.col("pt")), "left_semi",
        )
        found = cut(met.union(asked.where("t is null")).select("key", "wid", "len", "start").distinct(), "decon-found")
    return found


def row_key() -> Column:
    """A hash of id and text."""
    return F.sha1(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of id and text) and ws of each row; rows that repeat share a key."""
    text = docs.select("doc_id", "text")
    return text.select("doc_id", row_key().alias("key"), terms("text").alias("ws"))


def phrase_matches(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Exact matches: per document (key, n_hit), and the items of each document (key, item)."""
    corpus = with_keys(docs)
    windows, items = benchmark_windows(bench, n)
    anchors = rare_anchors(corpus, windows)
    found = intersect(index_postings(corpus, anchors), anchors)
    phrases = measured_broadcast(windows.select("wid", "phrase"), F.octet_length(F.array_join("phrase", " ")), 400)
    tries = found.join(phrases, "wid").groupBy("key").agg(F.collect_list(F.struct("wid", "start", "len", "phrase")).alias("tries"))
    tries = cut(tries, "decon-tries")  # a document's list is bounded by its length
    wanted = sized_broadcast(tries.select("key"), 64)
    texts = corpus.select("key", "ws").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    equal = F.filter("tries", lambda c: F.slice(F.col("ws"), c["start"] + 1, c["len"]) == c["phrase"])
    hits = texts.join(tries, "key").select("key", equal.alias("hits")).where(F.size("hits") > 0)
    words = F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1)))
    hits = cut(
        hits.select("key", F.size(F.array_distinct(words)).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda c: c["wid"])).alias("wids")),
        "decon-hits",
    )
    named = hits.select("key", F.explode("wids").alias("wid")).join(sized_broadcast(items, 80), "wid").select("key", "item").distinct()
    return hits.select("key", "n_hit"), named


def proximity_matches(docs: DataFrame, bench: DataFrame, slop: int = 4, n: int = WINDOW) -> DataFrame:
    """doc_id and item of documents where a window's rarest terms occur within slop words of their places."""
    corpus = with_keys(docs)
    windows, items = benchmark_windows(bench, n)
    anchors = rare_anchors(corpus, windows)
    found = intersect(index_postings(corpus, anchors), anchors, slop=slop)
    near = found.select("key", "wid").distinct().join(items, "wid").select("key", "item").distinct()
    return corpus.select("doc_id", "key").join(near, "key").select("doc_id", "item").distinct()


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    hits, named = phrase_matches(docs, bench)
    ids = named.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids"))
    found = hits.join(ids, "key").withColumnRenamed("key", "hit_key")
    found = measured_broadcast(cut(found, "decon-result"), F.octet_length("ids"), 200)
    rows = with_keys(docs).select("doc_id", "key", F.size("ws").cast("long").alias("n_words"))
    joined = rows.join(found, rows["key"] == found["hit_key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (HIT_PART * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).drop("key")


OP3_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item, array_to_string(ws[i:i+12], ' ') as phrase, least(13, len(ws)) as n
  from (select item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(ws[i:i+n-1], ' ') as phrase
  from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n)),
m as (select dw.rid, dw.i, dw.n, bw.item from dw join bw on dw.phrase = bw.phrase and dw.n = bw.n),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rid, item from m) group by rid)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
  sha256(coalesce(t.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.ws) as contaminated
from d left join h on d.rid = h.rid left join t on d.rid = t.rid
"""
