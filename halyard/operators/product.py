"""Product quantisation: a codebook per slice of the vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.vector import finite
from halyard.operators.search import SearchError, ranked


@dataclass(frozen=True)
class Codebook:
    """centroids: subquantizers x ksub x (dimensions / subquantizers)."""

    centroids: np.ndarray

    @property
    def subquantizers(self) -> int:
        return self.centroids.shape[0]

    @property
    def ksub(self) -> int:
        return self.centroids.shape[1]

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]

    @property
    def size_bytes(self) -> int:
        return 4 * self.centroids.size

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each slice, the first on a tie."""
        parts = x.reshape(len(x), self.subquantizers, -1)
        out = np.empty((len(x), self.subquantizers), dtype=np.int32)
        for m in range(self.subquantizers):
            c = self.centroids[m]
            out[:, m] = ((c * c).sum(axis=1)[None, :] - 2 * parts[:, m] @ c.T).argmin(axis=1)
        return out

    def table(self, query: list[float]) -> np.ndarray:
        """Squared distance of each slice of a query to each centroid."""
        q = np.asarray(query, dtype=float).reshape(self.subquantizers, 1, -1)
        return ((self.centroids - q) ** 2).sum(axis=2)


#: Rows a centroid that the first centroids are drawn from.
SEED_ROWS = 16


def _first_centroids(x: np.ndarray, ksub: int, seed: int) -> np.ndarray:
    """k-means++ over a sample of one slice: each next centroid is a row drawn
    by its squared distance to the nearest so far; all at 0, any row."""
    draw = np.random.default_rng(seed)
    found = [x[draw.integers(len(x))]]
    near = ((x - found[0]) ** 2).sum(axis=1)
    while len(found) < ksub:
        total = near.sum()
        found.append(x[draw.choice(len(x), p=near / total) if total > 0 else draw.integers(len(x))])
        near = np.minimum(near, ((x - found[-1]) ** 2).sum(axis=1))
    return np.stack(found)


def _sums(rows: DataFrame, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows of every centroid of every slice, in one
    pass: a task sends on one row a centroid, and as many reach the driver."""
    parts, ksub, step = book.centroids.shape
    names = ["m", "j", "n", *[f"s{i}" for i in range(step)]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, ksub, step)), np.zeros((parts, ksub), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, step)
                code = book.codes(x.reshape(len(x), -1))
                for m in range(parts):
                    np.add.at(total[m], code[:, m], x[:, m])
                    n[m] += np.bincount(code[:, m], minlength=ksub)
        m, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (m.astype(np.int32), j.astype(np.int32), n[m, j], *total[m, j].T)], names=names)

    partial = rows.mapInArrow(scan, ", ".join(["m int, j int, n long", *[f"{c} double" for c in names[3:]]]))
    total, n = np.zeros((parts, ksub, step)), np.zeros((parts, ksub), dtype=np.int64)
    for r in partial.groupBy("m", "j").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():
        n[r["m"], r["j"]], total[r["m"], r["j"]] = r["n"], r[3:]
    return total, n


def train(vectors: DataFrame, subquantizers: int = 8, ksub: int = 256, iterations: int = 15, tolerance: float = 1e-4, seed: int = 42, vector_column: str = "embedding") -> Codebook:
    """A codebook by k-means of every slice, all slices in one pass an
    iteration. First centroids come from SEED_ROWS rows a centroid, those of
    the least hash; every row counts in the iterations. A centroid without
    rows moves to the row of that sample furthest from its own. The driver
    holds the sample and the centroids, whose sizes do not follow the data."""
    rows = vectors.where(finite(F.col(vector_column))).select(F.col(vector_column).cast("array<double>").alias("v"))
    first = rows.first()
    if first is None:
        raise SearchError("no vectors to train on")
    size = len(first["v"])
    if subquantizers < 1 or size % subquantizers:
        raise SearchError(f"{size} dimensions do not split into {subquantizers} slices")
    if not 2 <= ksub <= 256:
        raise SearchError("a slice has 2 to 256 centroids")
    rows = rows.where(F.size("v") == size).persist()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(SEED_ROWS * ksub).collect()])
    if len(sample) < ksub:
        rows.unpersist()
        raise SearchError(f"fewer than {ksub} vectors to train on")
    parts = sample.reshape(len(sample), subquantizers, -1)
    centroids = np.stack([_first_centroids(parts[:, m], ksub, seed + m) for m in range(subquantizers)])
    for _ in range(iterations):
        total, n = _sums(rows, Codebook(centroids))
        moved = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], centroids)
        for m, j in np.argwhere(n == 0):
            gap = ((parts[:, m, None, :] - moved[m][None]) ** 2).sum(axis=2).min(axis=1)
            moved[m, j] = parts[gap.argmax(), m]
        shift = np.abs(moved - centroids).max()
        centroids = moved
        if shift <= tolerance:
            break
    rows.unpersist()
    return Codebook(centroids)


def encode(vectors: DataFrame, book: Codebook, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(id, code): an array of one number per slice."""
    rows = vectors.where(finite(F.col(vector_column), book.dimensions)).select(F.col(id_column).cast("long").alias(id_column), F.col(vector_column).cast("array<double>").alias("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            code = book.codes(x) if batch.num_rows else np.zeros((0, book.subquantizers), dtype=np.int32)
            ends = np.arange(0, code.size + 1, book.subquantizers, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, code.ravel())], names=[id_column, "code"])

    return rows.mapInArrow(scan, f"`{id_column}` long, code array<int>")


def product_knn(encoded: DataFrame, book: Codebook, query: list[float], k: int, id_column: str = "id") -> DataFrame:
    """(id, score): the k least sums of the query's distances to the codes'
    centroids, ties to the smaller id. The table is one number per centroid."""
    if k < 1 or len(query) != book.dimensions:
        raise SearchError("k must be positive and the query of the codebook's dimensions")
    flat = F.array(*[F.lit(float(x)) for x in book.table(query).ravel()])
    score = F.aggregate(F.transform("code", lambda c, m: F.get(flat, m * book.ksub + c)), F.lit(0.0), lambda s, x: s + x)
    return ranked(encoded, score, k, False, id_column).select(id_column, "score")
