"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every document of a smaller doc_id, cut into blocks by
content: windows of WINDOW words that share their least GRAM-word hash form a
block, so equal passages have equal blocks wherever they stand, and every
window lies in one block. The index deals all blocks by that anchor.

A block that stands whole in a smaller document is one factor. The others are
parsed word by word against all reference blocks of their anchor: a match is
extended to both sides of the anchor as far as the words agree, the parse takes
the longest match at each place and goes on at its end, factors of WINDOW words
or more are duplicate spans, and at the end of each factor the windows that
straddle it are looked up in the same matches.

Whole blocks meet by 128-bit hashes, in aggregations that keep one row per
task, so a passage that a third of all documents share costs a row per task,
and no pair of documents is formed. Anchors that many different blocks share
are split by deeper content (buckets.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import units
from halyard.llm.buckets import KIND, RUN, judged, shared_runs
from halyard.llm.common import materialize, spread_join

WINDOW = 50
GRAM = 12
#: Blocks of an anchor that are parsed in one task.
BUCKET = 1024

LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """ord (doc_id, null last), dk (a hash of the row) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64("doc_id", "text").alias("dk"), F.col("text").cast("string").alias("text"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def unit_values(raw: np.ndarray, at: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number per unit (word or byte) and the first unit of each text."""
    if not by_word:
        return units.byte_values(raw), at
    starts, ends, first = units.words(raw, at)
    return units.word_hashes(raw, starts, ends), first


def block_index(keyed_docs: DataFrame, window: int, gram: int, by_word: bool) -> DataFrame:
    """A row per block: anchor key, 128-bit hash, the row's dk and ord, first
    window, windows, and the anchor's offset in the first window."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in units.slices(batch, 2):
                values, first = unit_values(raw, at, by_word)
                r = units.Runs(values, first, window, gram)
                own = r.low - first[r.text]
                yield pa.RecordBatch.from_arrays([signed(r.key), signed(r.h1), signed(r.h2), pa.array(numbers(rows, "dk")[r.text]), pa.array(numbers(rows, "ord")[r.text]), pa.array(own.astype(np.int32)), pa.array(r.count.astype(np.int32)), pa.array(r.offset.astype(np.int32))], names=["key", "h1", "h2", "dk", "ord", "low", "n", "off"])

    return keyed_docs.select("ord", "dk", "text").mapInArrow(scan, RUN)


def listed(rows: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two parallel list columns, flat, and the row of each element. Null
    lists are empty."""
    a, b = rows.column(column), rows.column(column + 1)
    lengths = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def spans_per_row(spans: DataFrame) -> DataFrame:
    """(dk, ord, low list, n list): what is removed of each row; at most a
    span per window of the row."""
    return spans.groupBy("dk", "ord").agg(F.collect_set(F.struct("low", "n")).alias("s"))


def covered(first: np.ndarray, low: np.ndarray, n: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Whether each unit is covered by a window starting at low to low + n - 1
    of its text."""
    edge = np.zeros(first[-1] + 1, dtype=np.int32)
    np.add.at(edge, first[text] + low, 1)
    np.add.at(edge, first[text] + low + n + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def strings(data: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def keep_words(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    kept = np.flatnonzero(keep)
    text = np.searchsorted(first, kept, "right") - 1
    joined = np.r_[text[1:] == text[:-1], False] if len(kept) else np.zeros(0, dtype=bool)
    out = np.r_[raw, np.uint8(0)]
    out[ends[kept][joined]] = 0x20
    edge = np.zeros(len(raw) + 2, dtype=np.int8)
    np.add.at(edge, starts[kept], 1)
    np.add.at(edge, ends[kept] + joined, -1)
    inside = np.cumsum(edge[: len(raw)], dtype=np.int32) > 0
    return strings(out[:-1][inside], np.r_[0, np.cumsum(inside, dtype=np.int64)][at], pa.string())


def parse(reach: np.ndarray, window: int) -> np.ndarray:
    """Which windows (by their first word) of a block are duplicates. reach:
    the end of the longest match that holds each place.

    Greedy: a factor runs from its place to the end of the longest match
    there, and the next one begins at its end. A place whose match is under
    `window` words is passed over."""
    long_ = reach - np.arange(len(reach)) >= window
    found = np.zeros(len(reach), dtype=bool)
    at = 0
    while at < len(reach):
        more = np.flatnonzero(long_[at:])
        if not len(more):
            break
        at += int(more[0])
        end = int(reach[at])
        found[at : end - window + 1] = True
        # Windows that straddle the factor's end.
        edge = slice(end - window + 1, end)
        found[edge] |= long_[edge]
        at = end
    return found


def parse_bucket(window: int):  # noqa: ANN201
    """Parses each block of an anchor against those of a smaller ord."""

    def judge(group: list[tuple]) -> list[tuple]:
        group.sort(key=lambda g: (g[7], g[6], g[8]))
        raw = np.frombuffer(b"".join([g[12] for g in group]), dtype=np.uint8)
        starts, ends, first = units.words(raw, np.r_[0, np.cumsum([len(g[12]) for g in group])])
        hashes = units.word_hashes(raw, starts, ends)
        anchor = max(g[10] for g in group)
        lengths = np.diff(first)
        shift = np.array([anchor - g[10] for g in group])
        # A row per block, the anchor in one column; 0: no word.
        words = np.zeros((len(group), int((shift + lengths).max()) + 1), dtype=np.uint64)
        block = np.repeat(np.arange(len(group)), lengths)
        words[block, np.arange(len(hashes)) - first[block] + shift[block]] = hashes | np.uint64(1)
        ords = [g[7] for g in group]
        out, before = [], 0
        for k, g in enumerate(group):
            if ords[k] != ords[k - 1]:
                before = k
            if not before:
                continue
            same = (words[:before] == words[k]) & (words[k] != 0)
            left = anchor - np.argmin(np.concatenate([same[:, :anchor][:, ::-1], np.zeros((before, 1), dtype=bool)], axis=1), axis=1)
            right = anchor + np.argmin(same[:, anchor:], axis=1)
            reach = np.zeros(words.shape[1], dtype=np.int64)
            np.maximum.at(reach, left, right)
            reach = np.maximum.accumulate(reach)[shift[k] : shift[k] + lengths[k]] - shift[k]
            edge = np.flatnonzero(np.diff(np.r_[False, parse(reach, window), False].astype(np.int8)))
            out += [(*g[3:9], a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return out

    return judge


def duplicate_spans(keyed_docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(dk, ord, low, n): windows low to low + n - 1 (in words) of a row that
    also start in a document of a smaller ord. Rows may overlap."""
    blocks = materialize(block_index(keyed_docs, window, gram, True), "blocks")
    found, kinds = shared_runs(blocks, across=True)
    total = found.count()
    placed = materialize(spread_join(found, kinds.select(*KIND, "n", "first"), KIND, total), "placed")
    factors = placed.where("first < ord").select("dk", "ord", "low", "n")
    mixed = kinds.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("least"), F.max("first").alias("most")).where("n > 1 AND least < most").select("key", "n", F.col("n").alias("size_"))
    open_ = spread_join(kinds.drop("n"), mixed, ["key"], total).withColumn("single", F.lit(True))

    def leaf(equal: DataFrame) -> DataFrame:
        equal = equal.withColumn("at", F.col("off") - F.col("lo"))
        least = equal.groupBy("b", "core").agg(F.count("*").alias("n"), F.min("ord").alias("least"))
        many = equal.count()
        return spread_join(equal.drop("n"), least, ["b", "core"], many).where("least < ord").select(*KIND, "dk", "ord", "low", "at", F.lit(1).alias("n"))

    parsed = materialize(judged(keyed_docs, open_, bucket, window, gram, True, parse_bucket(window), leaf), "parsed")
    # What holds for a kind's first run holds for its others in the same document.
    spans = parsed.groupBy(*KIND).agg(F.collect_set(F.struct("at", F.col("n").alias("m"))).alias("s"))
    spans = spans.join(kinds.select(*KIND, "n"), KIND)
    own = spread_join(placed.where("first = ord"), spans, KIND, total)
    own = own.select("dk", "ord", "low", F.explode("s").alias("s")).select("dk", "ord", (F.col("low") + F.col("s.at")).alias("low"), F.col("s.m").alias("n"))
    return factors.unionByName(own)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed (long) and kept (the kept words joined by one
    space) for every row of docs (doc_id, text; other columns are ignored).

    A word goes if a window of `window` words that covers it also starts in a
    document with a smaller doc_id. Null and empty texts have no words. A null
    doc_id counts as larger than any other, and rows that share a doc_id never
    remove from one another, repeated rows included. Texts under `window` words
    are kept whole, longer ones are read whole at any length. An empty table
    gives an empty one.

    A row goes by its doc_id and a 64-bit hash of doc_id and text."""
    rows = keyed(docs)
    spans = spans_per_row(duplicate_spans(rows, window, gram, bucket))
    joined = rows.withColumn("doc_id", F.when(F.col("ord") < LAST, F.col("ord"))).join(spans, ["dk", "ord"], "left").select("doc_id", "dk", "text", "s.low", "s.n")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in units.slices(batch, 2):
                starts, ends, first = units.words(raw, at)
                low, n, text = listed(part, 3)
                gone = covered(first, low, n, text, window)
                removed = np.add.reduceat(np.r_[gone, False], first[:-1]).astype(np.int64) if len(gone) else np.zeros(part.num_rows, dtype=np.int64)
                removed[first[1:] == first[:-1]] = 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(removed), keep_words(raw, at, starts, ends, first, ~gone)], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")
