"""Operator 13: a trie of conversation prefixes, its subtrees summed by peeling leaves.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks; its pieces are put
in order by one row a piece. A turn's place and its content give two 64-bit names, and the names of a prefix are the
exclusive or of those of its turns: sums by piece and over pieces, without a task that sees a whole conversation. Equal
prefixes are one node, whose number is (least member, depth).

Peeling: a node holds the number of its open children and the exclusive or of their members, and what done children have
sent. A node without open children is done and sends its totals to its parent, once. A node with a single open child knows
that child from the exclusive or; it points there and, each round, at what its target points at, adding the target's sums
on the way, so that a chain of n turns is done in log n rounds instead of n. The rounds end when the root is done.

A node's ends are hashed in a stream: ids are joined in pieces of at most CHUNK, and one task reads a node's pieces in order,
one at a time.

Edge cases: a null role or text is empty; a null turn comes first; equal turns are ordered by role and text, and repeated
rows are turns of their own; rows of a null conv_id belong to no conversation and are left out; a negative conv_id takes
the base that SQL's remainder gives; a conversation of any length or turns of any length are read in whole; an empty table
has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm.shared import SPACED_WORD, cut, drop_cut

#: Conversations of one block share their base's first turns, fewer than HEADS.
BLOCK, HEADS = 20, 4
#: Least and most conv_id of a piece of ends are this far apart at most.
CHUNK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, at, ca, cb, words) of each turn, at from 1, and (conv_id, size). The names stand for role and text."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    # Bounds of ranges are sampled to the driver, so they hold the beginning of a text only; whole texts settle ties in a task.
    dealt = rows.withColumn("head", F.substring("text", 1, 64)).repartitionByRange("conv_id", "turn", "role", "head")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("nth", F.monotonically_increasing_id())
    names = [F.xxhash64("role", "text").alias("ca"), F.xxhash64(F.lit("b"), "text", "role").alias("cb")]
    dealt = cut(dealt.select("conv_id", F.shiftright("nth", 33).alias("part"), "nth", *names, F.regexp_count("text", F.lit(SPACED_WORD)).cast("long").alias("words")), "trie-turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.min("nth").alias("start"), F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a piece of a conversation
    parts = cut(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    turns = dealt.join(parts.drop("n"), ["conv_id", "part"])
    turns = turns.select("conv_id", "part", (F.col("nth") - F.col("start") + F.col("before") + 1).alias("at"), "ca", "cb", "words")
    return turns, parts.groupBy("conv_id").agg(F.sum("n").alias("size"))


def rebuilt_turns(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, part, depth, ca, cb, words), and (conv_id, total) with their lengths."""
    own = F.col("conv_id")
    asks = sizes.select("conv_id", "size", (F.crc32(own.cast("string").cast("binary")) % HEADS).alias("h"), (own - own % BLOCK).alias("base"))
    given = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    asks = asks.join(given, "base", "left").withColumn("k", F.least("h", F.coalesce("base_size", F.lit(0))))
    asks = cut(asks.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total")), "trie-asks")
    heads = turns.where((F.col("at") < HEADS) & (own % BLOCK == 0)).select(F.col("conv_id").alias("base"), "at", "ca", "cb", "words")
    borrowed = asks.where("k > 0").join(heads, "base").where("at <= k").select("conv_id", F.lit(-1).cast("long").alias("part"), F.col("at").alias("depth"), "ca", "cb", "words")
    kept = turns.join(asks.select("conv_id", "h", "k"), "conv_id").where("at > h")
    kept = kept.select("conv_id", "part", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "ca", "cb", "words")
    return borrowed.union(kept), asks.select("conv_id", "total")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, words, the names (a, b) of the prefix that ends there and those (ua, ub) of the one before."""
    rows = cut(rebuilt.select("conv_id", "part", "depth", "words", F.xxhash64("ca", "depth").alias("pa"), F.xxhash64("cb", "depth").alias("pb")), "trie-rebuilt")
    parts = rows.groupBy("conv_id", "part").agg(F.bit_xor("pa").alias("xa"), F.bit_xor("pb").alias("xb"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a piece
    zero = F.lit(0).cast("long")
    parts = parts.select("conv_id", "part", F.coalesce(F.bit_xor("xa").over(earlier), zero).alias("xa"), F.coalesce(F.bit_xor("xb").over(earlier), zero).alias("xb"))
    here = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)  # a piece is what one task sorted
    sums = rows.withColumns({"la": F.bit_xor("pa").over(here), "lb": F.bit_xor("pb").over(here)}).join(parts, ["conv_id", "part"])
    a, b = F.col("la").bitwiseXOR(F.col("xa")), F.col("lb").bitwiseXOR(F.col("xb"))
    return sums.select("conv_id", "depth", "words", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("pa")).alias("ua"), b.bitwiseXOR(F.col("pb")).alias("ub"))


def ends_of(ends: DataFrame) -> DataFrame:
    """depth, a, b and the SHA-256 of the conv_ids of (depth, a, b, conv_id) that end there, ascending, joined by commas."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    pieces = ends.groupBy("depth", "a", "b", F.floor(F.col("conv_id") / CHUNK).cast("long").alias("piece")).agg(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for depth, a, b, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (depth, a, b) != now:
                    if now is not None:
                        found.append((*now, state.hexdigest()))
                    now, state = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield digests(found)
        if now is not None:
            yield digests([(*now, state.hexdigest())])

    def digests(found: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=["depth", "a", "b", "ends_sha256"])

    dealt = pieces.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "piece").drop("piece")
    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv_id, depth, a, b, parent_conv_id, n_convs, n_children, open_id, own), and the digests of their ends."""
    rebuilt, lengths = rebuilt_turns(*placed_turns(conversations))
    members = cut(prefixes(rebuilt), "trie-members")
    zero = F.lit(0).cast("long")
    found = members.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("ua").alias("ua"), F.min("ub").alias("ub"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("ua"), F.lit(None).cast("long").alias("ub"))
    found = cut(found.select(root.columns).union(root), "trie-found")
    above = F.col("depth") - 1
    children = found.where("depth > 0").groupBy(above.alias("depth"), F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count("*").alias("n_children"), F.bit_xor("conv_id").alias("open_id"))
    top = found.where("depth = 0").select("conv_id").first()
    # Every first turn has the root for its parent; other parents are joined, and adaptive execution splits those of many children.
    parents = found.where("depth > 0").select(F.col("depth").alias("pd"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("parent_conv_id"))
    deep = found.where("depth > 1").withColumn("pd", above).join(parents, ["pd", "ua", "ub"]).drop("pd")
    flat = found.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top[0] if top else None).cast("long")))
    nodes = deep.select(flat.columns).union(flat).join(children, ["depth", "a", "b"], "left")
    nodes = nodes.select("conv_id", "depth", "a", "b", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "open_id", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    last = members.select("conv_id", "depth", "a", "b").join(lengths.select("conv_id", F.col("total").alias("depth")), ["conv_id", "depth"])
    none = lengths.where("total = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    return cut(nodes, "trie-nodes"), cut(ends_of(last.unionByName(none)), "trie-ends")


def peel(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, saved and leaves summed over each node's subtree.

    nodes: conv_id, depth, parent_conv_id, n_children, open_id (exclusive or of the children's conv_ids), own.
    """
    leaf, single = F.col("n_children") == 0, F.col("n_children") == 1
    state = cut(nodes.select(
        "conv_id", "depth", "parent_conv_id", F.col("n_children").alias("open"), "open_id", leaf.alias("done"), leaf.alias("fresh"),
        F.when(single, F.col("open_id")).alias("to_id"), F.when(single, F.col("depth") + 1).alias("to_depth"),
        F.col("own").alias("saved"), F.when(leaf, 1).otherwise(0).cast("long").alias("leaves"),
    ), "trie-state")
    while state.where("not done").limit(1).count():
        later = cut(jump(receive(state)), "trie-state")
        drop_cut(state)
        state = later
    return state.select("conv_id", "depth", "saved", "leaves")


def receive(state: DataFrame) -> DataFrame:
    """What nodes that became done in the round before send, summed by parent. A parent of one open child gets it by its pointer."""
    sent = state.where("fresh and depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n"), F.bit_xor("conv_id").alias("ids"), F.sum("saved").alias("s"), F.sum("leaves").alias("l")
    )
    hit = (F.col("open") >= 2) & F.col("n").isNotNull()
    keep = lambda to, name: F.when(hit, to).otherwise(F.col(name)).alias(name)
    left, ids = F.col("open") - F.col("n"), F.col("open_id").bitwiseXOR(F.col("ids"))
    done, single = hit & (left == 0), hit & (left == 1)
    return state.join(sent, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", keep(left, "open"), keep(ids, "open_id"), (F.col("done") | F.coalesce(done, F.lit(False))).alias("done"),
        F.coalesce(done, F.lit(False)).alias("fresh"), F.when(single, ids).otherwise(F.col("to_id")).alias("to_id"),
        F.when(single, F.col("depth") + 1).otherwise(F.col("to_depth")).alias("to_depth"),
        keep(F.col("saved") + F.col("s"), "saved"), keep(F.col("leaves") + F.col("l"), "leaves"),
    )


def jump(state: DataFrame) -> DataFrame:
    """Nodes of one open child take what their target has: its totals if it is done, else its sums and its own target."""
    waits = ~F.col("done") & (F.col("open") == 1)
    seen = state.where("done or open = 1").select(
        F.col("conv_id").alias("to_id"), F.col("depth").alias("to_depth"), F.col("done").alias("t_done"), F.col("to_id").alias("t_id"),
        F.col("to_depth").alias("t_depth"), F.col("saved").alias("t_saved"), F.col("leaves").alias("t_leaves"),
    )
    moved = state.where(waits).join(seen, ["to_id", "to_depth"], "left")
    onward = F.coalesce(~F.col("t_done"), F.lit(False))
    done = F.coalesce(F.col("t_done"), F.lit(False))
    moved = moved.select(
        "conv_id", "depth", "parent_conv_id", "open", "open_id", done.alias("done"), done.alias("fresh"),
        F.when(onward, F.col("t_id")).otherwise(F.col("to_id")).alias("to_id"), F.when(onward, F.col("t_depth")).otherwise(F.col("to_depth")).alias("to_depth"),
        (F.col("saved") + F.coalesce("t_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("t_leaves", F.lit(0))).alias("leaves"),
    )
    return state.where(~waits).select(moved.columns).union(moved)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    nodes, ends = trie(conversations)
    totals = peel(nodes)
    joined = nodes.join(totals, ["conv_id", "depth"]).join(ends, ["depth", "a", "b"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# DuckDB lacks crc32: 3988292384 is its polynomial, and conv_ids are hashed digit by digit.
OP13_SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 20 as base, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda d: ascii(d)::bigint)),
    lambda r, d: list_reduce([xor(r, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 4 as h
  from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, t.i, t.role, t.text from c join t on t.conv_id = c.base and t.i <= c.h
  union all select c.conv_id, 1, t.i, t.role, t.text from c join t on t.conv_id = c.conv_id and t.i > c.h),
o as (select conv_id, row_number() over (partition by conv_id order by own, i) as depth, {'r': role, 't': text} as x from r),
s as (select c.conv_id, coalesce(l.xs, []) as xs from c left join (select conv_id, list(x order by depth) as xs from o group by conv_id) l using (conv_id)),
m as (select conv_id, d as depth, xs[1:d] as p, len(xs) = d as ends from (select conv_id, xs, unnest(range(0, len(xs) + 1)) as d from s)),
n as (select depth, p, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as ids from m group by depth, p),
w as (select *, (n_convs - 1) * case when depth = 0 then 0 else len(regexp_extract_all(p[depth].t, '[^\x20\x09-\x0D]+')) end as own from n),
k as (select depth - 1 as depth, p[1:depth - 1] as p, count(*) as n_children from n where depth > 0 group by all),
f as (select w.depth, w.p, w.conv_id, w.n_convs, w.own, w.ids, coalesce(k.n_children, 0) as n_children from w left join k using (depth, p)),
u as (select m.depth, m.p, sum(f.own) as saved, sum(case when f.n_children = 0 then 1 else 0 end) as leaves from f join m on m.conv_id = f.conv_id and m.depth <= f.depth group by m.depth, m.p)
select f.conv_id, cast(f.depth as bigint) as depth, b.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(u.leaves as bigint) as n_leaves, cast(u.saved as bigint) as saved_tokens, sha256(f.ids) as ends_sha256
from f join u using (depth, p) left join f b on b.depth = f.depth - 1 and b.p = f.p[1:f.depth - 1]
"""
