"""Substring dedup over bytes by deep-shallow suffix sorting.

The suffixes that matter are those at content anchors: all 400-byte windows
whose least 64-byte hash stands at one place form a run, and equal windows
have their anchors at equal offsets. Suffixes are bucketed by their anchor.
Equal runs are one suffix with a count, and all windows of a run with a count
of two are repeated. One run of each kind is sorted, those with a count beside
the single ones: multikey quicksort on 8-byte symbols to a shallow depth beyond
the anchor, then a blind trie for the suffixes that still agree, rightwards
from the anchor and leftwards before it. Common prefix lengths of the two
orders say which windows two suffixes share.

A bucket of more than BUCKET suffixes is split by deeper content first
(buckets.py), so it spreads over tasks and every part is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import units
from halyard.llm.buckets import KIND, judged, shared_runs
from halyard.llm.common import materialize, spread_join
from halyard.llm.substrings import LAST, block_index, covered, keyed, listed, spans_per_row, strings

WINDOW = 400
GRAM = 64
#: Bytes that multikey quicksort compares before a blind trie takes over.
SHALLOW = 32
#: Suffixes of a bucket that are sorted in one task, and those compared pairwise.
BUCKET = 4096
FEW = 48


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that share a long prefix. Inner nodes hold a depth and a
    branch per byte there (-1: the string ends), leaves a string's number and
    its equals. A string is compared in full with one leaf only."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts = parts
        self.root: list | None = None

    def insert(self, i: int) -> None:
        s = self.parts[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:
            byte = s[node[0]] if len(s) > node[0] else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        leaf = self.parts[node[1][0]]
        depth = common_prefix(s, leaf)
        if depth == len(s) == len(leaf):
            node[1].append(i)
            return
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = (node, s[node[0]]), node[1][s[node[0]]]
        own = s[depth] if len(s) > depth else -1
        if node[0] == depth:
            node[1][own] = [None, [i]]
            return
        split = [depth, {leaf[depth] if len(leaf) > depth else -1: node, own: [None, [i]]}]
        if above:
            above[0][1][above[1]] = split
        else:
            self.root = split

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(parts: list[bytes], shallow: int = SHALLOW, start: int = 0) -> list[int]:
    """Numbers of the strings in byte order; equal ones in any order. All
    strings agree in the first `start` bytes."""
    out: list[int] = []
    shallow += start
    stack = [(list(range(len(parts))), start)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(parts)
            for i in group:
                trie.insert(i)
            out += trie.order()
        else:
            symbol = {i: parts[i][depth : depth + 8] for i in group}
            pivot = sorted(symbol[i] for i in group[:: max(1, len(group) // 9)][:9])[min(len(group), 9) // 2]
            less, same, more = [], [], []
            for i in group:
                (less if symbol[i] < pivot else more if symbol[i] > pivot else same).append(i)
            stack += [(more, depth), (same, depth + 8 if len(pivot) == 8 else shallow), (less, depth)]
    return out


def shared_windows(runs: list[tuple[bytes, int, int]], window: int = WINDOW, gram: int = 0) -> list[np.ndarray]:
    """For each run (its bytes, the anchor's offset, its windows): which of
    its windows some other run of the bucket has too. gram: bytes of the anchor
    that all runs share."""
    k = len(runs)
    right = [c[off:] for c, off, _ in runs]
    left = [c[:off][::-1] for c, off, _ in runs]
    found = [np.zeros(n, dtype=bool) for _, _, n in runs]
    order = deep_shallow(right, start=gram)
    near = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:])]

    def mark(a: int, before: int, after: int) -> None:
        """Windows with at most `before` bytes left of the anchor and at most
        `after` from it on are shared."""
        _, off, n = runs[a]
        first, last = max(0, off - before), min(n - 1, off + after - window)
        if first <= last:
            found[a][first : last + 1] = True

    if k <= FEW:
        for x in range(k - 1):
            after = window
            for y in range(x + 1, k):
                after = min(after, near[y - 1])
                if after < window - max(len(left[order[x]]), 1):
                    break
                a, b = order[x], order[y]
                before = common_prefix(left[a], left[b])
                mark(a, before, after)
                mark(b, before, after)
        return found
    left_order = deep_shallow(left)
    near = np.array(near)
    left_near = np.array([common_prefix(left[a], left[b]) for a, b in zip(left_order, left_order[1:])])
    offs, counts = np.array([r[1] for r in runs]), np.array([r[2] for r in runs])
    for before in range(int((offs - counts).min()) + 1, int(offs.max()) + 1):
        own = np.flatnonzero((before <= offs) & (before > offs - counts))
        if len(own) < 2:
            continue
        side = np.zeros((2, k), dtype=np.int64)
        side[0, order] = np.r_[0, np.cumsum(near < window - before)]
        side[1, left_order] = np.r_[0, np.cumsum(left_near < before)]
        _, which, times = np.unique(side[0, own] * k + side[1, own], return_inverse=True, return_counts=True)
        for a in own[times[which] > 1]:
            found[a][offs[a] - before] = True
    return found


def sort_bucket(window: int, gram: int):  # noqa: ANN201
    """Sorts a bucket and gives the shared windows of its single runs."""

    def judge(group: list[tuple]) -> list[tuple]:
        out = []
        for g, hit in zip(group, shared_windows([(g[12], g[10], g[9]) for g in group], window, gram)):
            if g[11] and hit.any():
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                out += [(*g[3:9], a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return out

    return judge


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(dk, ord, low, n): windows low to low + n - 1 of a row that also start
    elsewhere. Rows may overlap."""
    index = materialize(block_index(rows, window, gram, False), "runs")
    found, kinds = shared_runs(index, across=False)
    total = found.count()
    whole = spread_join(found, kinds.where("n > 1").select(*KIND, "n"), KIND, total).select("dk", "ord", "low", "n")
    keys = kinds.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("n") == 1).alias("open")).where("n > 1 AND open > 0").select("key", "n", F.col("n").alias("size_"))
    # One run of each kind stands for its copies.
    suffixes = spread_join(kinds.withColumn("single", F.col("n") == 1).drop("n"), keys, ["key"], total)

    def leaf(equal: DataFrame) -> DataFrame:
        equal = equal.withColumn("at", F.col("off") - F.col("lo"))
        twice = equal.groupBy("b", "core").agg(F.count("*").alias("n")).where("n > 1")
        many = equal.count()
        return spread_join(equal.drop("n"), twice, ["b", "core"], many).where("single").select(*KIND, "dk", "ord", "low", "at", F.lit(1).alias("n"))

    sorted_ = judged(rows, suffixes, bucket, window, gram, False, sort_bucket(window, gram), leaf)
    return whole.unionByName(sorted_.select("dk", "ord", (F.col("low") + F.col("at")).alias("low"), "n"))


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long) and kept (the bytes that
    remain) for every row of docs (doc_id, text; other columns are ignored).

    A byte goes if a string of `window` bytes that covers it also starts
    anywhere else, in the same text or in another row; so all copies go,
    repeated rows included. Null text is empty; texts under `window` bytes are
    kept whole, longer ones are read whole at any length; an empty table gives
    an empty one. Kept bytes need not be valid UTF-8.

    A row goes by its doc_id and a 64-bit hash of doc_id and text."""
    rows = keyed(docs)
    spans = spans_per_row(repeated_spans(rows, window, gram, bucket))
    joined = rows.join(spans, ["dk", "ord"], "left").select(F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "dk", "text", "s.low", "s.n")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in units.slices(batch, 2):
                low, n, text = listed(part, 3)
                gone = covered(at, low, n, text, window)
                sums = np.r_[0, np.cumsum(gone)]
                begins = gone & ~np.r_[False, gone[:-1]]
                begins[at[:-1][np.diff(at) > 0]] = gone[at[:-1][np.diff(at) > 0]]
                spans_before = np.r_[0, np.cumsum(begins)]
                removed = sums[at[1:]] - sums[at[:-1]]
                kept = strings(raw[~gone], at - sums[at], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(removed), pa.array(spans_before[at[1:]] - spans_before[at[:-1]]), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
