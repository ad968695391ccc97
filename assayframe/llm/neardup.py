"""Operator 4: near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Each document's distinct shingles are hashed. Documents with equal sets form a class; one row per class goes on.
2. A class gets a signature of COORDINATES minima. Each (coordinate, value) pair that two classes share is a token.
3. Tokens are ordered by how many classes have them. Two classes that agree in MATCHES coordinates or more share one of
   each other's COORDINATES - MATCHES + 1 rarest tokens, so only that prefix is posted and the most frequent tokens,
   such as those of a passage that many documents quote, are skipped.
4. A posting carries the low byte of every coordinate, so the skipped tokens are merged in where two postings meet: their
   collisions are counted inside the join, and only pairs of MATCHES or more come out of it. Such pairs are confirmed on
   the full sets, 100 * intersection >= 75 * union.
5. Lists are not paired off. First each class meets the most central class of its most frequent list, which joins most
   of a large group of near copies by a link per member. Then the members of each list that are outside its largest group
   meet the most central member of that group. Central is who has the most frequent tokens, so few words of its own.
6. What is still apart is held against an exact bound: of the shingles of a class, those that no other group of the open
   lists has can't be in an intersection. The others are ordered by how many open classes have them, and two classes of a
   similarity of 0.75 share one of each other's rarest, so only that prefix is posted, and its lists are those that are
   paired off between groups. Members of one group never meet again, and no link between groups is left untried.
7. There two classes also hold their parities against each other: bit i tells whether an odd number of a set's shingles
   have a hash of i in its lowest bits. Each shingle that only one set has changes one bit, so parities that differ in
   more bits than a similarity of 0.75 leaves to such shingles refute the pair inside the join, exactly. Sets beyond some
   PARITIES * 7 / 4 shingles never differ in so many bits, and there the counted collisions alone decide.

A pair at a similarity of exactly 0.75 agrees in fewer than MATCHES = 24 of 64 coordinates with probability 5e-11; it is
this that could lose a link, nothing else is capped. Low bytes that agree by chance only add pairs to confirm.

Edge cases: null, empty or blank texts have no shingles, no links, and are kept; fewer words than a shingle form one
shingle; equal texts and repeated rows link; among repeated doc_ids all rows get one component; a null doc_id links
with nothing and its component is null; very long texts are read in whole; other columns stay in `near_duplicates`, but
columns of its own names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.components import components
from assayframe.llm.shared import WordHashes, drop_cut, mix64, released, sized_broadcast, window_hashes
from assayframe.llm.shared import cut_tidily as cut  # each step is read from its files only

SHINGLE = 5
COORDINATES = 64
MATCHES = 24
SIMILARITY = 75
#: Bits of a set's parities, a power of two.
PARITIES = 1024
#: Low bytes of the coordinates lie in lanes of 9 bits, 7 to a long, so that a sum never runs into the next lane.
LANE, LANES = 9, 7
LONGS = -(-COORDINATES // LANES)
FULL = sum(0xFF << (LANE * i) for i in range(LANES))
TOP = sum(1 << (LANE * i + 8) for i in range(LANES))

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SALTS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(n, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """Least value of each of COORDINATES permutations, as 32 bits; the set isn't empty."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(found), 4096):
            x = found[lo : lo + 4096, None] ^ SALTS[None, :]
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(best, x.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def low_bytes(sig: np.ndarray) -> np.ndarray:
    """The low byte of each coordinate, packed into lanes."""
    lanes = np.zeros(LONGS * LANES, np.int64)
    lanes[:COORDINATES] = sig & 0xFF
    return (lanes.reshape(LONGS, LANES) << (LANE * np.arange(LANES))).sum(axis=1)


def parities(found: np.ndarray) -> np.ndarray:
    """For each value of the lowest bits of a hash, whether an odd number of hashes have it; as longs."""
    odd = np.bincount((found & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def may_be_similar(nx: str, ny: str, x: str, y: str) -> Column:
    """False only for sets (of nx and ny shingles, with parities x and y) that aren't similar enough: an intersection is at
    least SIMILARITY / (100 + SIMILARITY) of both sizes, and what is outside it is as many shingles as parities differ, or more."""
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITIES // 64)), F.lit(0))
    return (100 + SIMILARITY) * apart <= (100 - SIMILARITY) * (F.col(nx) + F.col(ny))


def collisions(x: str, y: str) -> Column:
    """Coordinates whose low bytes agree; a lane of the difference, plus 255, reaches its top bit unless it is zero."""
    apart = sum(
        (F.bit_count((F.col(x)[i].bitwiseXOR(F.col(y)[i]) + F.lit(FULL)).bitwiseAND(F.lit(TOP))) for i in range(LONGS)), F.lit(0)
    )
    return F.lit(COORDINATES) - apart


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set in two longs, the signature, its low bytes and the set's parities (null for empty sets)."""

    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, keys, sigs, lows, bits = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    found = shingles(t, hashes)
                    sizes.append(len(found))
                    keys.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64))
                    sigs.append(signature(found) if len(found) else None)
                    lows.append(low_bytes(sigs[-1]) if len(found) else None)
                    bits.append(parities(found) if len(found) else None)
                key = np.array(keys).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()),
                     pa.array(sigs, pa.list_(pa.int32())), pa.array(lows, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig", "low", "bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>, low array<long>, bits array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """c (the doc_id) and set (sorted shingle hashes) of each row."""

    def run(batches):
        hashes = WordHashes()
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, hashes).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "c long, set array<long>")


def postings(sigs: DataFrame) -> DataFrame:
    """(token, df, c, w, n, low): each class under the rarest COORDINATES - MATCHES + 1 of its tokens, if another class has
    them. w is the sum of df over all its tokens."""
    token = F.expr("transform(sig, (v, i) -> (cast(i as bigint) << 32) | (cast(v as bigint) & 4294967295L))")
    every = sigs.select("c", F.explode(token).alias("token"))
    common = every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = every.join(common, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"), F.sum("df").alias("w"))  # at most COORDINATES each
    # Tokens that nobody else has are the rarest of all, and take places of the prefix.
    room = F.size("ts") - (MATCHES - 1)
    lists = lists.where(room > 0).select("c", "w", F.slice("ts", 1, room).alias("ts")).join(sigs.select("c", "n", "low"), "c")
    return lists.select("c", "w", "n", "low", F.explode("ts").alias("t")).select("t.token", "t.df", "c", "w", "n", "low")


def confirmed(likely: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b), already cut, whose full sets are similar enough. Only their texts are shingled again."""
    wanted = cut(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct(), "near-wanted")
    texts = docs.select("doc_id", "text").join(sized_broadcast(wanted, 16), "doc_id", "left_semi")
    found = shingle_sets(texts)
    sets = cut(found.groupBy("c", F.xxhash64("set").alias("k")).agg(F.first("set").alias("set")), "near-sets")
    xa = sets.select(F.col("c").alias("a"), F.col("set").alias("xa"))
    xb = sets.select(F.col("c").alias("b"), F.col("set").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    similar = 100 * both >= SIMILARITY * (F.size("xa") + F.size("xb") - both)
    out = cut(likely.join(xa, "a").join(xb, "b").where(similar).select("a", "b"), "near-links")
    drop_cut(sets, wanted)
    return out


def pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def in_several(lists: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one group."""
    several = lists.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token")
    return lists.join(several, "token")


def open_lists(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings, with group g, of the lists that hold more than one group."""
    own = groups.select(F.col("node").alias("c"), F.col("component").alias("g"))
    grouped = posted.join(own, "c", "left").select("token", "c", "w", "n", "low", F.coalesce("g", "c").alias("g"))
    return cut(in_several(grouped), "near-open")


def central() -> Column:
    """Of several classes the one with the most frequent tokens, then of the least id."""
    return F.max_by(F.struct("c", "low"), F.struct(F.col("w"), -F.col("c")))


def main_groups(lists: DataFrame) -> DataFrame:
    """Per list its largest group, and the group's most central member."""
    sizes = lists.groupBy("token", "g").agg(F.count("*").alias("k"), central().alias("one"))
    most = sizes.groupBy("token").agg(F.max(F.struct("k", "g", "one")).alias("most"))
    return most.select("token", F.col("most.g").alias("main"), F.col("most.one.c").alias("lead"), F.col("most.one.low").alias("lead_low"))


def rare_shingles(lists: DataFrame, docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Postings like those of `lists`, with parities, their tokens being the rarest shingles of each class that another group has too."""
    least = lists.groupBy("token").agg(F.min("n").alias("m"))
    members = lists.join(least, "token").groupBy("c", "g").agg(F.first("w").alias("w"), F.first("n").alias("n"), F.min("m").alias("m"), F.first("low").alias("low"))
    members = cut(members.join(sigs.select("c", "bits"), "c"), "near-members")
    texts = docs.select("doc_id", "text").join(sized_broadcast(members.select(F.col("c").alias("doc_id")), 16), "doc_id", "left_semi")
    sets = shingle_sets(texts).select("c", F.explode("set").alias("token")).distinct()
    rows = cut(sets.join(members.select("c", "g"), "c").select("token", "c", "g"), "near-shingles")
    common = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token", "df")
    ranked = rows.join(common, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))  # a text's own shingles
    # An intersection is 3/7 of both sizes at least; a partner is no smaller than the least class of the lists that are
    # shared with it, nor than 0.75 of the class.
    partner = F.greatest(F.col("m"), F.ceil(F.col("n") * SIMILARITY / 100))
    room = F.size("ts") - F.ceil(SIMILARITY * (F.col("n") + partner) / (100 + SIMILARITY)) + 1
    found = ranked.join(members, "c").where(room > 0).select("c", "g", "w", "n", "low", "bits", F.explode(F.slice("ts", F.lit(1), room.cast("int"))).alias("t"))
    found = cut(in_several(found.select("t.token", "c", "g", "w", "n", "low", "bits")), "near-rare")
    drop_cut(members, rows)
    return found


def class_groups(sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Groups of classes: node and component, for classes with a link. sigs: c, n, sig, low, bits."""
    posted = cut(postings(sigs), "near-postings")
    tested = []

    def step(groups: DataFrame | None, met: DataFrame) -> DataFrame:
        """Groups after the pairs of `met` that weren't tested before are confirmed."""
        met = met.distinct()
        for old in tested:
            met = met.join(old, ["a", "b"], "left_anti")
        likely = cut(met, "near-likely")
        tested.append(likely)
        if likely.isEmpty():
            return groups
        links = confirmed(likely, docs)
        if groups is not None:
            if links.isEmpty():
                return groups
            links = links.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return cut(components(links), "near-groups")

    def ended(groups: DataFrame, *steps: DataFrame) -> DataFrame:
        """groups, when nothing will read the steps again."""
        drop_cut(posted, top, *tested, *steps)
        return groups

    top = posted.groupBy("c").agg(F.max_by(F.struct("token", "w", "low"), F.struct("df", "token")).alias("t")).select("c", "t.*")
    top = cut(top, "near-top")
    leads = top.groupBy("token").agg(central().alias("one")).select("token", F.col("one.c").alias("lead"), F.col("one.low").alias("lead_low"))
    first = top.join(leads, "token").where((F.col("c") != F.col("lead")) & (collisions("low", "lead_low") >= MATCHES))
    groups = step(None, first.select(*pair("c", "lead")))
    if groups is None:
        groups = cut(sigs.select(F.col("c").alias("node"), F.col("c").alias("component")).where("false"), "near-groups")

    lists = open_lists(posted, groups)
    met = lists.join(main_groups(lists), "token").where((F.col("g") != F.col("main")) & (collisions("low", "lead_low") >= MATCHES))
    groups = step(groups, met.select(*pair("c", "lead")))
    drop_cut(lists)

    lists = open_lists(posted, groups)
    if lists.isEmpty():
        return ended(groups, lists)
    rare = rare_shingles(lists, docs, sigs)
    drop_cut(lists)
    lists = cut(rare.join(main_groups(rare).select("token", "main"), "token"), "near-left")
    drop_cut(rare)
    x = lists.where("g <> main").select("token", F.col("c").alias("x"), F.col("g").alias("gx"), F.col("low").alias("lx"), F.col("n").alias("nx"), F.col("bits").alias("bx"), "main")
    y = lists.select("token", F.col("c").alias("y"), F.col("g").alias("gy"), F.col("low").alias("ly"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    met = x.join(y, "token").where(
        (F.col("gx") != F.col("gy")) & ((F.col("gy") == F.col("main")) | (F.col("gx") < F.col("gy"))) & (collisions("lx", "ly") >= MATCHES)
        & may_be_similar("nx", "ny", "bx", "by")
    )
    return ended(step(groups, met.select(*pair("x", "y"))), lists)


def near_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, a row per row of docs; written, and the files of all steps before it are deleted."""
    every = cut(signed(docs), "near-signed")
    some = every.where("n_shingles > 0 and doc_id is not null")
    sigs = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("c"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"), F.first("bits").alias("bits"))
    sigs = cut(sigs, "near-signatures")
    groups = class_groups(sigs, docs)
    placed = sigs.join(groups, sigs["c"] == groups["node"], "left").select("k1", "k2", F.coalesce("component", "c").alias("component_id"))
    plain = every.select("doc_id", "n_shingles", "k1", "k2")
    joined = plain.join(placed, ["k1", "k2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    found = cut(joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "near-ids")
    drop_cut(every, sigs, groups)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with n_shingles, component_id and kept (doc_id = component_id); rows of one doc_id get one answer."""
    keyed = near_ids(docs).groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    keyed = keyed.select(F.struct("doc_id", "n_shingles", "component_id").alias("found"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(keyed, F.col("row.doc_id").eqNullSafe(F.col("found.doc_id")))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    return joined.select(*own, "found.n_shingles", "found.component_id", F.col("row.doc_id").eqNullSafe(F.col("found.component_id")).alias("kept"))


def kept_rows(docs: DataFrame, row: str) -> DataFrame:
    """The values of column `row`, a long that is unique and never null, of one row per group of near duplicates.

    Rows are compared, not doc_ids, so rows of a null or repeated doc_id are told apart. Of a group the row of the least
    doc_id stays, and of its rows the first by `row`; rows without shingles all stay.
    """
    groups = near_ids(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    named = groups.join(docs.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id")), "_row")
    return named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("least")).select(F.col("least._row").alias(row))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
