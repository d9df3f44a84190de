"""Quantised vectors: sign codes, scalar codes and their distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.vector import doubles


def sign_words(vector: Column, dimensions: int) -> Column:
    """Bit i of the code is v[i] > 0, lowest bit first, in 64-bit words."""

    def word(w: int) -> Column:
        bits = F.transform(F.slice(doubles(vector), w * 64 + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return F.array(*[word(w) for w in range(-(-dimensions // 64))])


def sign_bytes(vector: Column, dimensions: int, first_highest: bool = False) -> Column:
    """The same code as bytes; first_highest: bit 0 is a byte's highest."""

    def byte(b: int) -> Column:
        shift = (lambda i: 7 - i) if first_highest else (lambda i: i)
        bits = F.transform(F.slice(doubles(vector), b * 8 + 1, 8), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), shift(i))).otherwise(F.lit(0)))
        return F.lpad(F.hex(F.aggregate(bits, F.lit(0), lambda a, x: a.bitwiseOR(x))), 2, "0")

    return F.unhex(F.concat(*[byte(b) for b in range(-(-dimensions // 8))]))


def words_of_bytes(code: Column, size: int) -> Column:
    """A packed binary code of `size` bytes as 64-bit words."""
    digits = F.rpad(F.hex(code), 16 * -(-size // 8), "0")
    return F.array(*[F.conv(F.substring(digits, 16 * w + 1, 16), 16, -10).cast("long") for w in range(-(-size // 8))])


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two codes of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)


def bit_similarity(distance: Column, dimensions: int) -> Column:
    return 1 - distance / F.lit(float(dimensions))


def train_scalar(vectors: DataFrame, column: str = "embedding") -> tuple[float, float]:
    """Least and largest component of all vectors; NaN is not looked at, and
    (0, 1) if there is none."""
    kept = F.filter(doubles(F.col(column)), lambda x: ~F.isnan(x))
    low, high = vectors.select(F.array_min(kept).alias("low"), F.array_max(kept).alias("high")).agg(F.min("low"), F.max("high")).first()
    return (0.0, 1.0) if low is None else (low, high)


def scalar_encode(vector: Column, low: float, high: float) -> Column:
    """Components as 0 to 255, rounded half away from zero, clamped; all zero
    if there is no range."""
    if high == low:
        return F.transform(vector, lambda x: F.lit(0))
    return F.transform(doubles(vector), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x - low) * 255 / (high - low)).cast("int"))))


def scalar_decode(code: Column, low: float, high: float) -> Column:
    return F.transform(code, lambda q: low + q * (high - low) / 255)


def scalar_l2_squared(a: Column, b: Column) -> Column:
    """In code units, which are not those of the vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def scalar_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
