"""Distances and similarities of dense vectors, as column expressions and as
the same in numpy for batches of queries. Arithmetic is in doubles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_vector(values: list[float] | np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def dot_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def hamming_float(a: Column, b: Column) -> Column:
    """Places where one vector is zero and the other is not."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: ((x != 0) != (y != 0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(doubles(a), lambda x: x / size)).otherwise(doubles(a))


def finite(a: Column, dimensions: int | None = None) -> Column:
    """Not null, of the wanted length, and without null, NaN or infinity."""
    ok = a.isNotNull() & F.forall(doubles(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & (F.size(a) == dimensions) if dimensions else ok, F.lit(False))


@dataclass(frozen=True)
class Metric:
    """A named metric: the expression, the same for a matrix of queries and a
    matrix of vectors, and whether larger is nearer."""

    code: int | None
    expression: Callable[[Column, Column], Column]
    matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]
    similarity: bool


def _norms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = _norms(a, b)
    return np.where(size == 0, 0.0, a @ b.T / np.where(size == 0, 1, size))


def _l2_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(near, 0)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = (a != 0).astype(np.float64), (b != 0).astype(np.float64)
    return x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)


#: By name; codes are fixed values of the search interface. The graph index's
#: "cosine" is dot_distance: it does not normalise.
METRICS = {
    "l2": Metric(0, l2, lambda a, b: np.sqrt(_l2_squared(a, b)), False),
    "cosine": Metric(1, cosine, _cosine, True),
    "dot": Metric(2, dot, lambda a, b: a @ b.T, True),
    "hamming_float": Metric(3, hamming_float, _hamming, False),
    "l2_squared": Metric(None, l2_squared, _l2_squared, False),
    "dot_distance": Metric(None, dot_distance, lambda a, b: 1 - a @ b.T, False),
}


def to_unit_score(metric: str, distance: Column) -> Column:
    """A distance as a score from 0 to 1; what is not finite scores 0.

    cosine: 1 - d within bounds; l2: 1 / (1 + d); dot: 1 / (1 + exp(d))."""
    score = {
        "cosine": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)),
        "l2": 1 / (1 + distance),
        "dot": 1 / (1 + F.exp(distance)),
    }[metric]
    ok = distance.isNotNull() & ~F.isnan(distance) & (F.abs(distance) != float("inf"))
    return F.when(ok, score).otherwise(F.lit(0.0))


def rescored_similarity(l2_squared_: Column) -> Column:
    return 1 / (1 + l2_squared_)
