"""Whole texts as arrays: words, hashes of any range, and content anchors.

Everything here works on the bytes of an Arrow column, a few megabytes at a
time, without a Python loop over words or bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is taken alone.
SLICE_BYTES = 1 << 18

_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random number for each byte.
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: Odd multipliers of the two rolling hashes.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i under n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=_U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


class Ranges:
    """Hashes of any range of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        up, self.down = powers(_BASES[which], len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after another and each text's start (and
    the last's end). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about SLICE_BYTES of text: rows, bytes, offsets."""
    raw, at = column_bytes(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(low, high - low), raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (with the
    number of words last). Words are runs without 0x20 and 0x09 to 0x0D."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    gap = _SEPARATOR[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    starts = np.flatnonzero(~gap & (first[:-1] | np.r_[True, gap[:-1]]))
    ends = np.flatnonzero(~gap & (first[1:] | np.r_[gap[1:], True])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; lower: with A-Z as a-z."""
    return Ranges(_BYTE[_LOWER[raw] if lower else raw])(starts, ends)


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


class Runs:
    """Windows of `window` units, grouped by their anchor.

    The anchor of a window is its least `gram`-unit hash, the leftmost on a
    tie, so equal windows have equal anchors wherever they stand. Consecutive
    windows of one text with one anchor are a run. values: a number per unit;
    first: the first unit of each text and the number of units."""

    def __init__(self, values: np.ndarray, first: np.ndarray, window: int, gram: int) -> None:
        n, w = len(values), window - gram + 1
        self.window = window
        self.ranges = Ranges(values, 0), Ranges(values, 1)
        empty = np.zeros(0, dtype=np.int64)
        self.low = self.count = self.text = self.offset = empty
        self.key = self.h1 = self.h2 = np.zeros(0, dtype=_U)
        if n < window:
            return
        least = self.ranges[0](np.arange(n - gram + 1), np.arange(gram, n + 1))
        grams = least
        place = np.arange(len(least))
        size = 1
        while 2 * size <= w:
            take = least[size:] < least[:-size]
            place = np.where(take, place[size:], place[:-size])
            least = np.where(take, least[size:], least[:-size])
            size *= 2
        if w > size:
            take = least[w - size :] < least[: size - w]
            place = np.where(take, place[w - size :], place[: size - w])
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(place)]
        whole = np.arange(len(place)) + window <= first[1:][text]
        change = np.flatnonzero(whole & np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]])
        if not len(change):
            return
        # Whole windows of a text stand together, so a run ends where the next
        # begins or its text's last window is.
        stop = np.minimum(np.r_[change[1:], len(place)], first[1:][text[change]] - window + 1)
        self.low, self.count, self.text = change, stop - change, text[change]
        self.offset = place[change] - change
        self.key = grams[place[change]]
        shift = self.offset.astype(_U) * _U(0x9E3779B97F4A7C15)
        self.h1, self.h2 = (mix(r(change, stop + window - 1) + shift) for r in self.ranges)
