"""Runs of windows that share a content anchor, dealt to tasks by anchor.

Windows of a text that share their least gram are a run (see units.Runs), and
equal windows have their anchors at equal offsets. So only runs of one anchor,
a bucket, can share windows. Equal runs are one kind, and a bucket meets one
run of each kind, with its bytes.

A bucket of too many kinds is split by deeper content: its offsets are halved,
and a run goes to the bucket of what all its windows of a half have in common.
That common part grows with each halving, until it is the window itself and
all runs of a bucket are equal there. So no bucket is gathered whole in one
task, and what judges a bucket is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import units
from halyard.llm.common import materialize, shuffle_partitions, spread_join

RUN = "key long, h1 long, h2 long, dk long, ord long, low int, n int, off int"
KIND = ["key", "h1", "h2"]
_CONTEXT = [("b", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("dk", pa.int64()), ("ord", pa.int64()), ("low", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("single", pa.bool_()), ("bytes", pa.binary()), ("core", pa.binary())]
_CONTEXT_DDL = "b long, lo int, hi int, key long, h1 long, h2 long, dk long, ord long, low int, n int, off int, single boolean, bytes binary, core binary"
#: A run's windows at to at + n - 1, counted from its first.
_FOUND = [("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("dk", pa.int64()), ("ord", pa.int64()), ("low", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]
FOUND_DDL = "key long, h1 long, h2 long, dk long, ord long, low int, at int, n int"
#: Units (bytes or words) of contexts that a task streams, about.
TASK_UNITS = 16 << 20
#: Documents of large buckets whose keys are broadcast, at most (about 40 MB of an executor).
PICKED = 1 << 20


def as_batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[n for n, _ in kinds])


def shared_runs(blocks: DataFrame, across: bool) -> tuple[DataFrame, DataFrame]:
    """The runs of anchors that stand more than once (across: in rows of
    different ord), and their kinds: key, h1, h2, n (runs of the kind), and of
    its first run first (its ord), dk, low, len and off."""
    total = blocks.count()
    ends = [F.min("ord").alias("least"), F.max("ord").alias("most")] if across else []
    keys = blocks.groupBy("key").agg(F.count("*").alias("n"), *ends).where("least < most" if across else "n > 1").select("key", "n")
    found = materialize(spread_join(blocks, keys, ["key"], total), "found")
    one = F.min(F.struct("ord", "dk", "low", "n", "off")).alias("one")
    kinds = found.groupBy(*KIND).agg(F.count("*").alias("n"), one)
    return found, materialize(kinds.select(*KIND, "n", F.col("one.ord").alias("first"), "one.dk", "one.low", F.col("one.n").alias("len"), "one.off"), "kinds")


def run_bytes(rows: DataFrame, kinds: DataFrame, window: int, by_word: bool, highest: int) -> DataFrame:
    """A context per kind: the bytes under all windows of its first run. kinds:
    key, h1, h2, first, dk, low, len, off, single. A document's runs travel as
    one array with its text."""
    per_doc = kinds.groupBy("dk", F.col("first").alias("ord")).agg(F.collect_list(F.struct("low", "len", "off", "key", "h1", "h2", "single")).alias("b"))
    joined = rows.join(per_doc, ["dk", "ord"]).select("ord", "dk", "text", "b.low", "b.len", "b.off", "b.key", "b.h1", "b.h2", "b.single")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in units.slices(batch, 2):
                lengths = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(part.num_rows), lengths)
                low, n, off = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
                if by_word:
                    starts, ends, first = units.words(raw, at)
                    begin, end = starts[first[text] + low], ends[first[text] + low + n + window - 2]
                else:
                    begin, end = at[text] + low, at[text] + low + n + window - 1
                size = end - begin
                edge = np.r_[0, np.cumsum(size)]
                data = raw[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
                whole = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                dk, ord_ = (part.column(i).to_numpy(zero_copy_only=False)[text] for i in (1, 0))
                key, h1, h2, single = (part.column(i).flatten() for i in (6, 7, 8, 9))
                columns = [key, np.zeros(len(low)), np.full(len(low), highest), key, h1, h2, dk, ord_, low, n, off, single, whole, [None] * len(low)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, (_, k) in zip(columns, _CONTEXT)], names=[n for n, _ in _CONTEXT])

    return joined.mapInArrow(scan, _CONTEXT_DDL)


def deeper(contexts: DataFrame, window: int, by_word: bool) -> DataFrame:
    """Contexts of large buckets, dealt by what the windows of each half of
    the bucket's offsets have in common; core: that, where it is the window."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                b, lo, hi, n, off, raw = row[0], row[1], row[2], row[9], row[10], row[12]
                bytes_ = np.frombuffer(raw, dtype=np.uint8)
                if by_word:
                    starts, ends, _ = units.words(bytes_, np.array([0, len(bytes_)]))
                middle = (lo + hi) // 2
                for a, z in ((lo, middle), (middle + 1, hi)):
                    if off < a or off - n + 1 > z:
                        continue
                    # The anchor stands at unit off; a window of offset o begins at off - o.
                    first, last = off - a, off - z + window
                    if by_word:
                        core = b" ".join([raw[s:e] for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist())])
                    else:
                        core = raw[first:last]
                    value = units.Ranges(units.byte_values(np.frombuffer(core, dtype=np.uint8)))(np.array([0]), np.array([len(core)]))
                    new = units.mix(value ^ units.mix(np.array([b & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) + np.uint64(a * 65537 + z)))
                    out.append((int(new.view(np.int64)[0]), a, z, *row[3:13], core if a == z else None))
            yield as_batch(out, _CONTEXT)

    return contexts.mapInArrow(scan, _CONTEXT_DDL)


def judged(rows: DataFrame, open_: DataFrame, bucket: int, window: int, gram: int, by_word: bool, judge: Callable[[list[tuple]], list[tuple]], leaf: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Windows found by judge(contexts of a bucket) in buckets of up to
    `bucket` kinds, and by leaf(contexts) where a bucket's kinds are equal in
    all that it judges (leaf: columns core, b and those of a context).

    open_: kinds to judge or to judge by, with single and size_, the kinds of
    their anchor."""
    open_ = materialize(open_, "open")
    weight, most = open_.agg(F.sum(F.col("len") + (window - 1)), F.max("size_")).first()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, group, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(13))):
                if row[0] != b:
                    if len(group) > 1:
                        out += judge(group)
                    b, group = row[0], []
                group.append(row)
            yield as_batch(out, _FOUND)
            out = []
        yield as_batch(judge(group) if len(group) > 1 else [], _FOUND)

    def streamed(small: DataFrame, units_: int) -> DataFrame:
        parts = max(shuffle_partitions(rows.sparkSession), -(-units_ // TASK_UNITS))
        return small.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(scan, FOUND_DDL)

    found = streamed(run_bytes(rows, open_.where(F.col("size_") <= bucket), window, by_word, window - gram), weight or 0)
    if (most or 0) <= bucket:
        return found
    large = open_.where(F.col("size_") > bucket)
    texts = large.select("dk", F.col("first").alias("ord")).distinct()
    # Texts without a run of a large bucket are not dealt for it. Where the
    # keys are too many to be broadcast, all texts are.
    picked = rows.join(F.broadcast(texts), ["dk", "ord"], "left_semi") if texts.count() <= PICKED else rows
    wide = run_bytes(picked, large, window, by_word, window - gram)
    while True:
        contexts = materialize(deeper(wide, window, by_word), "contexts")
        sizes = materialize(contexts.groupBy("b").agg(F.count("*").alias("n")).withColumn("size_", F.col("n")), "sizes")
        many, most, weight = contexts.count(), *sizes.agg(F.max("size_"), F.sum("n")).first()
        contexts = materialize(spread_join(contexts, sizes, ["b"], many), "sized")
        small = (F.col("size_") <= bucket) & (F.col("size_") > 1)
        found = found.unionByName(streamed(contexts.where(small).drop("size_"), (weight or 0) * 2 * window))
        if (most or 0) <= bucket:
            return found
        large = contexts.where(F.col("size_") > bucket).drop("size_")
        found = found.unionByName(leaf(large.where("lo = hi")))
        wide = large.where("lo < hi")
