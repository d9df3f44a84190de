"""Mixing sources to target weights, in DataFrame operations only.

Every source is a stream of its documents in a random order, cut into blocks
of words. How many blocks of each source the mix takes is an exact quota. A
splitting tree hands the quotas to output shards: at each node a multivariate
hypergeometric draw, one conditional hypergeometric variate per source, splits
the node's blocks between its two halves. Block b of a source sits at place
pi(b) of a permutation, so the shards draw disjoint runs of places, and rows
are ordered within a shard by a hash.

Sums over sources are tables, never lists on the driver; a source that holds
most rows is split into cells of about the square root of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.llm.common import WORD, materialize, shuffle_partitions, unit, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Sources of one node of the splitting tree; more are grouped in strata first.
FANOUT = 1024
#: A prime over any number of blocks of a source: steps of it permute them.
STEP = 2147483647
#: Words of a block, and of a shard.
BLOCK_WORDS = 2048
SHARD_WORDS = 1 << 20


def source_ranks(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 in code-point order, null last.

    Ranges are counted first and numbered next, so no task sees all sources."""
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(max(1, min(shuffle_partitions(spark), 64)), F.col("source").isNull(), F.col("source"))
    ranged = materialize(ranged.withColumn("range_", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range_").agg(F.count("*").alias("n"))
    # One row per range, 64 at most.
    starts = before.withColumn("start_", F.coalesce(F.sum("n").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = W.partitionBy("range_").orderBy(F.col("source").isNull(), "source")
    return ranged.withColumn("at_", F.row_number().over(within) - 1).join(F.broadcast(starts), "range_").withColumn("rank", (F.col("at_") + F.col("start_")).cast("long")).drop("range_", "at_", "start_")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size, rank) with `target` (double).

    The targets share `share` times all sizes by weight. One that passes
    `most` times its source's size stops there and the excess is shared again,
    until none is above: target = min(most * size, level * weight). Each round
    is one aggregate, and two numbers reach the driver."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = materialize(sources.withColumn("weight", w.cast("double")).withColumn("most_", F.col("source_size") * F.lit(most)), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stopped = F.col("most_") <= F.col("weight") * F.lit(level)
        full, open_ = sources.agg(F.sum(F.when(stopped, F.col("most_"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_:
            break
        now = (share * total - (full or 0.0)) / open_
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least("most_", F.col("weight") * F.lit(level))).drop("most_", "weight")


def hypergeometric(all_: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` among `all_` are in `drawn` draws without
    replacement, by inversion of u in [0, 1).

    Weights of the counts within 12 standard deviations of the mean follow
    from one another by their ratio; what lies beyond is under double
    precision."""
    low0 = F.greatest(F.lit(0), drawn - (all_ - good))
    high0 = F.least(good, drawn)
    n = F.greatest(all_, F.lit(1)).cast("double")
    mean = drawn.cast("double") * good / n
    spread = F.sqrt(mean * (1 - good / n) * (n - drawn) / F.greatest(n - 1, F.lit(1.0))) * 12 + 12
    low = F.greatest(low0, F.floor(mean - spread)).cast("long")
    high = F.least(high0, F.ceil(mean + spread)).cast("long")
    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<long>"))

    def ratio(k: Column) -> Column:
        return (good - k + 1).cast("double") * (drawn - k + 1) / (k.cast("double") * F.greatest(all_ - good - drawn + k, F.lit(1)))

    whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"] * ratio(k)).alias("s")), lambda a: a["s"])

    def pick(a: Column, k: Column) -> Column:
        w = a["w"] * ratio(k)
        passed = a["s"] <= a["u"]
        return F.struct(w.alias("w"), F.when(passed, a["s"] + w).otherwise(a["s"]).alias("s"), F.when(passed, k).otherwise(a["k"]).alias("k"), a["u"].alias("u"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), low.alias("k"), (u * whole).alias("u"))
    return F.aggregate(steps, start, pick, lambda a: a["k"])


def drawer(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """One source's part of a node's draw, given those before it."""

    def draw(a: Column, x: Column) -> Column:
        u = unit(F.lit(seed), F.lit(level), F.col("tree"), F.col("node"), x["source_no"])
        k = hypergeometric(a["all"], x["q"], a["drawn"], u)
        return F.struct((a["all"] - x["q"]).alias("all"), (a["drawn"] - k).alias("drawn"), F.concat(a["out"], F.array(k)).alias("out"))

    return draw


def split_quotas(quotas: DataFrame, sizes: DataFrame, depth: int, seed: int) -> DataFrame:
    """(tree, source_no, shard, k): the splitting tree.

    quotas: tree, source_no, q; at most FANOUT rows of one tree. sizes: tree,
    shard, slots, with 2 ** depth shards; a tree's slots sum to its quotas.
    A level is a projection and an explode, so nothing is shuffled below the
    roots."""
    root = quotas.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("source_no", "q"))).alias("own"))
    root = root.join(sizes.groupBy("tree").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "slots"))), lambda x: x["slots"]).alias("slots")), "tree")
    nodes = root.select("tree", F.lit(0).cast("long").alias("node"), "slots", F.col("own.source_no").alias("nos"), F.col("own.q").alias("qs"))
    empty = F.array().cast("array<long>")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    for level in range(depth):
        half = F.expr("cast(size(slots) / 2 AS int)")

        start = F.struct(total(F.col("qs")).alias("all"), total(F.slice("slots", F.lit(1), half)).alias("drawn"), empty.alias("out"))
        left = F.aggregate(F.arrays_zip(F.col("nos").alias("source_no"), F.col("qs").alias("q")), start, drawer(seed, level), lambda a: a["out"])
        nodes = nodes.withColumn("left", left).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        nodes = nodes.select(
            "tree",
            (F.col("node") * 2 + F.col("side")).alias("node"),
            F.when(F.col("side") == 0, F.slice("slots", F.lit(1), half)).otherwise(F.slice("slots", half + 1, half)).alias("slots"),
            "nos",
            F.when(F.col("side") == 0, F.col("left")).otherwise(F.zip_with("qs", "left", lambda q, k: q - k)).alias("qs"),
        )
    leaves = nodes.select("tree", F.col("node").alias("shard"), F.explode(F.arrays_zip(F.col("nos").alias("source_no"), F.col("qs").alias("k"))).alias("e"))
    return leaves.select("tree", "e.source_no", "shard", F.col("e.k").alias("k"))


def allocate(quotas: DataFrame, seed: int, blocks_per_shard: int) -> tuple[DataFrame, int]:
    """(source_no, shard, k) for quotas (source_no, q), and the shards' number.

    Shards differ by one block at most. Over FANOUT sources, a first tree
    splits strata of FANOUT sources and its results are the shard sizes of a
    tree within each stratum."""
    total, sources = quotas.agg(F.sum("q"), F.max("source_no")).first()
    if not total:
        return quotas.select("source_no", F.lit(0).cast("long").alias("shard"), F.col("q").alias("k")), 1
    depth = min(24, max(0, math.ceil(math.log2(total / blocks_per_shard)))) if total > blocks_per_shard else 0
    shards = 1 << depth
    spark = quotas.sparkSession
    even = spark.range(shards).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("shard"), F.expr(f"cast({total} div {shards} + if(id < {total} % {shards}, 1, 0) AS long)").alias("slots"))
    if sources < FANOUT:
        made = split_quotas(quotas.select(F.lit(0).cast("long").alias("tree"), "source_no", "q"), even, depth, seed)
        return made.drop("tree"), shards
    stratum = F.expr(f"source_no div {FANOUT}")
    by = quotas.groupBy(stratum.alias("source_no")).agg(F.sum("q").alias("q"))
    if sources >= FANOUT * FANOUT:
        top, _ = allocate(by, seed + 1, blocks_per_shard)
    else:
        top = split_quotas(by.select(F.lit(0).cast("long").alias("tree"), "source_no", "q"), even, depth, seed + 1).drop("tree")
    inner = top.select(F.col("source_no").alias("tree"), "shard", F.col("k").alias("slots"))
    made = split_quotas(quotas.select(stratum.alias("tree"), "source_no", "q"), inner, depth, seed)
    return made.drop("tree"), shards


def positions(rows: DataFrame, key: str, order: Column, size: str, count: str) -> DataFrame:
    """rows with `start`: the words before a row in its key's order.

    A key of n rows is cut by the order's hash into about sqrt(n) cells; cells
    are summed, then rows within a cell, so a hot key is never one task."""
    cells = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(count)))).cast("long")
    rows = rows.withColumn("order_", order).withColumn("cell_", F.floor(F.shiftrightunsigned("order_", 11) / F.lit(float(1 << 53)) * cells).cast("long"))
    by_cell = rows.groupBy(key, "cell_").agg(F.sum(size).alias("words_"))
    before = W.partitionBy(key).orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)
    by_cell = by_cell.withColumn("before_", F.coalesce(F.sum("words_").over(before), F.lit(0))).drop("words_")
    # Unsigned order of the hash, as the cells are cut.
    inside = W.partitionBy(key, "cell_").orderBy(F.shiftrightunsigned("order_", 11), "order_", "row_").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside_", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.join(by_cell, [key, "cell_"]).withColumn("start", F.col("before_") + F.col("inside_")).drop("order_", "cell_", "before_", "inside_")


def mix_sizes(sized: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The mix of rows (row_, id_, source, size): a plan and the draws.

    plan: row_, source_size, target for every row. draws: row_, pass (0, 1),
    words, shard, order: a row for each time that a document is drawn. Taken
    words of a source are its target rounded down: documents go whole except
    the one where the target is met, which gives its first words. `most` may
    be 2 at most, so a document is drawn at most twice, in two orders. Rows of
    no words are in the plan and are never drawn. An empty table gives none."""
    groups = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows_"))
    sources = materialize(targets(source_ranks(groups), share, most, weights).withColumn("take", F.floor("target").cast("long")), "targets")
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    plan = sized.alias("d").join(sources.alias("s"), same).select("d.row_", "d.id_", "d.size", F.col("s.rank").alias("source_no"), "s.source_size", "s.target", "s.take", "s.rows_")
    # Pass 1 takes every word once; pass 2 what the target asks beyond that.
    passes = plan.where("size > 0 AND take > 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")).where("pass = 0 OR take > source_size")
    stream = passes.withColumn("key_", F.col("source_no") * 2 + F.col("pass"))
    placed = positions(stream, "key_", F.xxhash64("id_", "pass", F.lit(seed)), "size", "rows_")
    placed = placed.withColumn("start", F.col("start") + F.col("pass") * F.col("source_size")).where("start < take")
    placed = placed.withColumn("words", F.least(F.col("size"), F.col("take") - F.col("start"))).withColumn("block", F.expr(f"start div {block_words}"))
    quotas = sources.where("take > 0").select(F.col("rank").alias("source_no"), F.expr(f"(take + {block_words - 1}) div {block_words}").alias("q"))
    shares, _ = allocate(quotas, seed, max(1, shard_words // block_words))
    shares = materialize(shares.where("k > 0"), "shares")
    ahead = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = shares.withColumn("from_", F.coalesce(F.sum("k").over(ahead), F.lit(0)))
    places = runs.select("source_no", "shard", F.explode(F.sequence("from_", F.col("from_") + F.col("k") - 1)).alias("place"))
    drawn = placed.join(quotas, "source_no").withColumn("place", F.pmod(F.col("block") * STEP + F.pmod(F.xxhash64("source_no", F.lit(seed)), F.lit(STEP)), F.col("q")))
    drawn = drawn.join(places, ["source_no", "place"]).select("row_", "pass", "words", "shard", F.xxhash64("id_", "pass", F.lit(seed + 1)).alias("order"))
    return plan.select("row_", "source_size", "target"), drawn


def mix_to_weights(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, plan, draws) of documents with columns doc_id, text, source.

    rows: row_ (a number of the row), id_, doc_id, source, size, with a null text's
    size 0. Repeated rows are drawn each on its own; a null source is a source
    (the last); rows with a null doc_id take part."""
    # Positions follow the hash, so reruns agree however the files are split;
    # the number only tells repeated rows apart.
    rows = docs.select(F.xxhash64("doc_id", "source", "text").alias("id_"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = materialize(rows.withColumn("row_", F.monotonically_increasing_id()), "rows")
    plan, draws = mix_sizes(rows.select("row_", "id_", "source", "size"), seed, block_words, shard_words)
    return rows, plan, draws


def mixed_summary(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards drawn to."""
    rows, plan, draws = mix_to_weights(docs, seed)
    per_row = draws.groupBy("row_").agg(F.sum("words").cast("long").alias("taken"), F.min(F.struct("pass", "shard"))["shard"].alias("shard"), F.max(F.when(F.col("pass") == 1, F.col("shard"))).alias("second_shard"))
    out = rows.join(plan, "row_").join(per_row, "row_", "left")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shard", "second_shard")


def mixed_documents(docs: DataFrame, seed: int = 17, **parameters: int) -> DataFrame:
    """The mix itself: docs' columns, a row for each draw, shard by shard in
    the shard's order; a document that is cut keeps its first words."""
    numbered = materialize(docs.select(F.struct("*").alias("doc_")).withColumn("row_", F.monotonically_increasing_id()), "docs")
    size = word_count(F.col("doc_.text"))
    sized = numbered.select("row_", F.xxhash64("doc_.doc_id", "doc_.source", "doc_.text").alias("id_"), F.col("doc_.source").alias("source"), size.alias("size"))
    _, draws = mix_sizes(sized, seed, **parameters)
    drawn = draws.join(numbered, "row_")
    first_words = F.array_join(F.slice(F.regexp_extract_all("doc_.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < size, first_words).otherwise(F.col("doc_.text"))
    drawn = drawn.withColumn("doc_", F.col("doc_").withField("text", text)).sortWithinPartitions("shard", "order")
    return drawn.select("doc_.*")
