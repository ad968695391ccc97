"""Operator 2: mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix, between 0 and 2. Among all rates that meet
the token target of each source, entropy balancing takes those nearest to 1 in the Fermi-Dirac entropy of that range.
Its convex dual has one multiplier per source, and the rates are exponentially tilted: r = 2 * e / (1 + e) with
e = exp(multiplier * size / mean size of the source). Newton iterations over the whole corpus' size classes solve it.

Documents of a source whose sizes agree to one part in 64 form a class and share a rate, so that the iterations read a
table whose length depends on the number of sources and the range of sizes, not on the number of documents.

Rates become copies from the largest class of a source to the smallest; what a class takes too much or too little is
carried to the next, and inside a class a hash of the document picks who gets one more copy. Nothing is random.

Edge cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, ranked last;
rows that repeat are each mixed; a null doc_id is an id like any other; an empty table gives no rows; other columns
are left alone and not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.llm.shared import SPACED_WORD, cut, drop_cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Classes per doubling of the size.
CLASSES = 64
#: Documents per bucket when a class is cut up to choose who gets one more copy.
BUCKET = 1000


def size_class(size):
    """Exact below CLASSES, then CLASSES steps per doubling."""
    k = F.floor(F.log2(size))
    fine = k * CLASSES + F.floor((size / F.pow(F.lit(2.0), k) - 1) * CLASSES)
    return F.when(size < CLASSES, size).otherwise(fine).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 by code point, null last: ranges of names sorted apart, then offset by range."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "mix-sources")
    before = (
        ranged.groupBy("part").agg(F.count("*").alias("n"))
        .select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    )  # one row per range
    local = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(F.broadcast(before), "part").select(
        "source", "source_size", "n_docs", (F.col("before") + local - 1).alias("rank")
    )


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds `target`: weight times a common level, at most cap times the source's size.

    Each pass fixes the sources above their cap and shares the rest among the others by weight, until none is above.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = cut(ranked_sources(sources).withColumn("weight", pick).withColumn("most", cap * F.col("source_size")), "mix-ranks")
    goal = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = (F.col("weight") * level > F.col("most")) if capped >= 0 else F.lit(False)
        row = s.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == capped:
            break
        capped = row["n"]
        if not row["open"]:
            level = float("inf")
            break
        level = (goal - row["fixed"]) / row["open"]
    if level == float("inf"):
        return s.withColumn("target", F.col("most"))
    return s.withColumn("target", F.least(F.col("most"), F.col("weight") * level))


def solve_rates(classes: DataFrame, targets: DataFrame, cap: float = CAP, most: int = 60) -> DataFrame:
    """classes with `rate`. Newton iterations on each source's multiplier, kept inside a bracket that only shrinks.

    A step that leaves the bracket is replaced by its middle, so sources with few or very unequal documents converge
    as well. Sources at their cap need no multiplier: their rate is the cap.
    """
    x = F.col("tokens") / F.col("n") / (F.col("source_size") / F.col("n_docs"))
    cells = cut(
        classes.join(targets, classes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        .where("source_size > 0")
        .select("source", "class", "n", "tokens", "target", x.alias("x"),
                (F.col("target") >= cap * F.col("source_size")).alias("full")),
        "mix-cells",
    )
    inner = cells.where(~F.col("full"))
    dual = cut(
        inner.groupBy("source").agg(F.first("target").alias("target"), F.max("x").alias("top"))
        .select("source", "target", F.lit(0.0).alias("mult"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")),
        "mix-dual",
    )
    rate = cap / (1 + F.exp(-F.col("mult") * F.col("x")))
    for _ in range(most):
        step = (
            inner.drop("target").join(dual, inner["source"].eqNullSafe(dual["source"])).drop(inner["source"])
            .withColumn("rate", rate)
            .groupBy("source").agg(
                F.first("target").alias("target"), F.first("mult").alias("mult"),
                F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                F.sum(F.col("rate") * F.col("tokens")).alias("got"),
                F.sum(F.col("rate") * (1 - F.col("rate") / cap) * F.col("x") * F.col("tokens")).alias("slope"),
            )
            .withColumn("off", F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
            .withColumn("lo", F.when(F.col("got") < F.col("target"), F.greatest("lo", "mult")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("got") > F.col("target"), F.least("hi", "mult")).otherwise(F.col("hi")))
            .withColumn("next", F.col("mult") + (F.col("target") - F.col("got")) / F.greatest(F.col("slope"), F.lit(1e-300)))
            .withColumn("middle", F.when(F.col("lo") == float("-inf"), F.least(2 * F.col("hi"), F.col("hi") - 1))
                        .when(F.col("hi") == float("inf"), F.greatest(2 * F.col("lo"), F.col("lo") + 1))
                        .otherwise((F.col("lo") + F.col("hi")) / 2))
            .withColumn("inside", (F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi"))
                        & (F.abs(F.col("next")) <= 2 * F.abs(F.col("mult")) + 4))
            .select("source", "target", "lo", "hi", "off",
                    F.when(F.col("off") < 1e-9, F.col("mult")).when(F.col("inside"), F.col("next"))
                    .otherwise(F.col("middle")).alias("mult"))
        )
        dual = cut(step, "mix-dual")
        if (dual.agg(F.max("off")).first()[0] or 0.0) < 1e-6:
            break
    solved = dual.select(F.col("source").alias("s"), "mult")
    return (
        cells.join(solved, cells["source"].eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("rate", F.when(F.col("full"), F.lit(cap)).otherwise(rate)).drop("mult", "x", "full")
    )


def round_classes(cells: DataFrame, cap: float = CAP) -> DataFrame:
    """cells with `copies`, a whole number for each class.

    Classes of a source are taken by falling size; each takes as many copies as bring the running sum nearest to the
    running target. A source has at most CLASSES classes per doubling of the size, so the array is bounded.
    """
    cell = F.struct(F.col("class"), F.col("n"), (F.col("tokens") / F.col("n")).alias("mean"), (F.col("rate") * F.col("tokens")).alias("want"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:bigint,n:bigint,copies:bigint>>").alias("out"))

    def take(acc, c):
        want = acc["carry"] + c["want"]
        copies = F.greatest(F.lit(0).cast("long"), F.least((c["n"] * cap).cast("long"), F.round(F.coalesce(F.try_divide(want, c["mean"]), F.lit(0.0))).cast("long")))
        return F.struct(
            (want - copies * c["mean"]).alias("carry"),
            F.concat(acc["out"], F.array(F.struct(c["class"].alias("class"), c["n"].alias("n"), copies.alias("copies")))).alias("out"),
        )

    lists = cells.groupBy("source").agg(F.sort_array(F.collect_list(cell), asc=False).alias("cells"))
    return lists.select("source", F.explode(F.aggregate("cells", start, take, lambda a: a["out"])).alias("c")).select("source", "c.*")


def document_sizes(docs: DataFrame, row: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, class, a hash that orders documents, from whole texts, and the columns `row`."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", F.lit("mix"), "text", *row).alias("h"), *row).withColumn(
        "class", F.when(F.col("size") > 0, size_class(F.col("size").cast("double"))).otherwise(F.lit(0).cast("long"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, row: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken and the columns `row` of every row of docs."""
    sized = cut(document_sizes(docs, row), "mix-sizes")
    classes = cut(sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "mix-classes")
    targets = cut(
        with_targets(classes.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, cap),
        "mix-targets",
    )
    cells = cut(solve_rates(classes, targets, cap), "mix-rates")
    copies = cut(round_classes(cells, cap).select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("n").alias("class_n"), F.col("copies").alias("class_copies")), "mix-copies")

    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    plan = t.join(copies, F.col("ts").eqNullSafe(F.col("s")), "left").drop("s")  # a row per source and class
    rates = cells.select(F.col("source").alias("rs"), F.col("class").alias("rc"), "rate")
    plan = cut(plan.join(rates, F.col("ts").eqNullSafe(F.col("rs")) & (F.col("c") == F.col("rc")), "left").drop("rs", "rc"), "mix-plan")
    placed = (
        sized.join(plan, sized["source"].eqNullSafe(plan["ts"]) & (sized["class"] == F.coalesce(plan["c"], F.lit(0))), "left")
        .drop("ts", "c")
        .withColumn("bucket", F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(F.col("class_n") / BUCKET))))
    )
    placed = cut(placed, "mix-placed")

    # Of the class's extra copies each bucket gets its share of the running sum; then the lowest hashes get one each.
    by_class = W.partitionBy("source", "class").orderBy("bucket")
    buckets = (
        placed.where("class_n is not null").groupBy("source", "class", "bucket")
        .agg(F.count("*").alias("n"), F.first("class_n").alias("class_n"), F.first("class_copies").alias("class_copies"))
        .withColumn("extra", F.col("class_copies") % F.col("class_n"))
        .withColumn("upto", F.sum("n").over(by_class))
        .withColumn("now", F.expr("(upto * extra) div class_n"))
        .select(F.col("source").alias("bs"), F.col("class").alias("bc"), F.col("bucket").alias("bb"),
                (F.col("now") - F.coalesce(F.lag("now").over(by_class), F.lit(0))).alias("quota"))
    )
    buckets = cut(buckets, "mix-buckets")
    order = F.row_number().over(W.partitionBy("source", "class", "bucket").orderBy("h", "doc_id", "size", *row))
    out = (
        placed.withColumn("place", order)
        .join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("class") == F.col("bc")) & (F.col("bucket") == F.col("bb")), "left")
        .withColumn("copies", F.coalesce(F.expr("class_copies div class_n") + (F.col("place") <= F.col("quota")).cast("long"), F.lit(0).cast("long")))
    )
    return out.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
                      F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("rate", F.lit(0.0)).alias("rate"),
                      "copies", (F.col("copies") * F.col("size")).alias("taken"), *row)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
