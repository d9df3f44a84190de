"""Best-fit packing with certified bin counts.

Documents become token ids (cut to the capacity), and the pieces are packed
into sequences of at most `capacity` tokens. Pieces are dealt to partitions;
each runs best-fit decreasing and compares its bins with a lower bound from
dual feasible functions. A partition whose bins equal the bound is certified
and final. The others give their worst-filled bins back; those documents meet
in new, fewer partitions and are packed again, until nothing is gained.

Only (id, length) rows move between tasks, a partition holds a bounded number
of pieces whatever the input, and pieces of full length need no packing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import held, lean, materialize

#: Distinct chunks of text whose ids a task remembers at once.
CACHE_ENTRIES = 400_000

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import json
        import os
        import re

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_rank = merges_by_id(spec)
        byte = byte_of_symbol()
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.plain = tiktoken.Encoding("plain", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]
        self.simple = re.compile(r" ?\S+").fullmatch
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_rank or "  " in text or "\0" in text or any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        chunks = text.replace(" ", "\0 ").split("\0")
        try:
            return b"".join([self.cache[c] for c in chunks])
        except KeyError:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            self.learn({c for c in chunks if c not in self.cache})
            return b"".join([self.cache[c] for c in chunks])

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks. Those of one word go in one call, a line each:
        a line end is a token of its own there."""
        lines = [c for c in chunks if self.simple(c)]
        for c in chunks.difference(lines):
            self.cache[c] = np.array(self.plain.encode_ordinary(c), dtype="<u4").tobytes()
        if lines:
            ids = np.array(self.plain.encode_ordinary("\n".join(lines)), dtype="<u4")
            ends = np.flatnonzero(ids == self.newline).tolist()
            raw = ids.tobytes()
            at = 0
            for c, e in zip(lines, [*ends, len(ids)]):
                self.cache[c] = raw[4 * at : 4 * e]
                at = e + 1


def merges_by_id(spec: dict) -> bool:
    """Whether merging by the least id is merging by this vocabulary's rules,
    and texts are cut as GPT2_PATTERN says. If not, texts go to tokenizers."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    return bool(plain) and all(a < b for a, b in zip(ids, ids[1:]))


def encoder_of(path: str) -> ChunkEncoder:
    """One encoder a worker, whatever the number of tasks it runs."""
    return held(ChunkEncoder, path)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for:
    printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text, an end id after them, cut to capacity.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32 and, on
    request, ids (little-endian unsigned 32-bit). A document of n ids has
    ceil(n / capacity) pieces; the first holds the remainder. Null text counts
    as empty: one piece with the end id. A repeated row has its own pieces.

    Byte-level BPE splits a text before every single space, whatever follows;
    so a text without doubled spaces is the concatenation of the ids of its
    chunks, and each distinct chunk is encoded once per task, by tiktoken over
    the same vocabulary (a tenth of the time for the same ids, see the tests).
    Texts with doubled spaces, special tokens or NUL go whole to tokenizers.
    So does every text where the vocabulary's merges are not in the order of
    their ids. The memory is bounded by CACHE_ENTRIES."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * capacity

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = (encoder.ids(text.as_py()) if text.is_valid else b"") + end
                at, piece = 0, 0
                cut = len(ids) % width or width
                while at < len(ids):
                    part = ids[at:cut]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(out, row):
                        column.append(value)
                    at, cut, piece = cut, cut + width, piece + 1
                    if with_ids and len(out[0]) >= 4096:
                        yield rows(out)
                        out = [[], [], [], [], [], []]
            yield rows(out)

    def rows(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if with_ids else 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], names=names[:n])

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(encode, keep=True), schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing needs, from dual feasible functions.

    The identity gives the volume bound. For each threshold t up to half the
    capacity, items over capacity - t count as a whole bin, items under t as
    nothing and the rest as they are (Martello and Toth's L2 family)."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    count = np.r_[0, np.cumsum(n)]  # items shorter than i
    mass = np.r_[0, np.cumsum(n * np.arange(capacity + 1))]
    t = np.arange(0, capacity // 2 + 1)
    over = count[-1] - count[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    return int(np.max(over + -(-middle // capacity)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins.

    Items go longest first into the fullest bin that takes them. Open bins are
    kept by free space, so an item costs a scan over at most capacity slots."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 2, dtype=bool)
    some[capacity + 1] = True
    made = 0
    for i in order.tolist():
        size = int(lengths[i])
        gap = size + int(some[size:].argmax())
        if gap > capacity:
            gap, b = capacity, made
            made += 1
        else:
            b = free[gap].pop()
            some[gap] = bool(free[gap])
        bins[i], offsets[i] = b, capacity - gap
        left = gap - size
        if left:
            free[left].append(b)
            some[left] = True
    return bins, offsets, made


def placer(capacity: int, r: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one partition. Bins marked open_ go to the next exchange: eight
    per bin over the lower bound, the worst-filled first, and one more, since
    every partition may end in a bin that is part empty."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        bins, offsets, made = best_fit_decreasing(lengths, capacity)
        gap = made - lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=made)
        again = np.zeros(made, dtype=bool)
        if not last:
            again[np.argsort(fill, kind="stable")[: 8 * gap + 1]] = True
        res = pdf.drop(columns=["part_"])
        res["sequence_id"] = ((np.int64(pdf["part_"].iloc[0]) * 8 + r) << 24) + bins
        res["offset"] = offsets
        res["open_"] = again[bins]
        return res

    return place


def pack(pieces: DataFrame, capacity: int = 1024, per_partition: int = 20_000, rounds: int = 3) -> DataFrame:
    """Place pieces in sequences: every row of `pieces` (it needs a column
    `length` of 1 to capacity) with sequence_id and offset added.

    A sequence holds offsets 0 to its end without gaps. An empty table packs
    into nothing. Equal lengths and repeated rows are placed one by one."""
    spark = pieces.sparkSession
    out = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left = pieces.where(F.col("length") < capacity)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    schema = ", ".join([*columns, "sequence_id long, offset long, open_ boolean"])
    seen = None
    for r in range(rounds):
        n = left.count()
        if not n:
            break
        parts = max(1, -(-n // per_partition))
        # Where a round gave every piece back, the next one places them all.
        last = r == rounds - 1 or parts == 1 or n == seen
        seen = n

        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns], F.monotonically_increasing_id(), F.lit(r)), F.lit(parts))
        placed = left.withColumn("part_", salt).groupBy("part_").applyInPandas(placer(capacity, r, last), schema)
        placed = materialize(placed, "packed")
        out = out.unionByName(placed.where("NOT open_").drop("open_"))
        left = placed.where("open_").drop("open_", "sequence_id", "offset")
        if last:
            break
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, per_partition: int = 20_000) -> DataFrame:
    """Tokenise documents and pack their pieces: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Columns other than doc_id and text are not
    looked at, whatever their names."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack(pieces, capacity, per_partition)
