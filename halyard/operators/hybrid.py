"""Fusion of a dense and a sparse result list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.operators.search import SearchError, knn_batch, sparse_knn
from halyard.functions.vector import METRICS

#: Fixed values of the search interface.
RRF_K, DENSE_K, SPARSE_K, FINAL_K = 60, 20, 20, 10


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """One row per query and id of either list."""
    d = dense.select("qid", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("qid", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    return d.join(s, ["qid", "id"], "full_outer")


def _top(rows: DataFrame, n: int) -> DataFrame:
    # By nine places, as sums of doubles depend on their order.
    order = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rrf(dense: DataFrame, sparse: DataFrame, n: int = FINAL_K, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), ranks from 1.

    dense, sparse: qid, id, score, rank. Returns qid, id, score, rank,
    dense_rank, sparse_rank, dense_score, sparse_score; n = 0 gives none."""
    share = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return _top(_both(dense, sparse).withColumn("score", share("dense_rank") + share("sparse_rank")), n)


def linear(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, n: int = FINAL_K) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, each list's scores scaled to 0
    to 1 (all equal: 1), a row that a list lacks at 0. Scores must be
    similarities: higher is nearer."""
    if not 0 <= alpha <= 1:
        raise SearchError("alpha must be from 0 to 1")
    every = W.partitionBy("qid")

    def scaled(rows: DataFrame) -> DataFrame:
        low, high = F.min("score").over(every), F.max("score").over(every)
        return rows.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))

    both = _both(scaled(dense), scaled(sparse))
    return _top(both.withColumn("score", alpha * F.coalesce("dense_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("sparse_score", F.lit(0.0))), n)


def hybrid_search(vectors: DataFrame, postings: DataFrame, queries: DataFrame, sparse_queries: DataFrame, dense_k: int = DENSE_K, sparse_k: int = SPARSE_K, n: int = FINAL_K, fusion: str = "rrf", alpha: float = 0.5, k: int = RRF_K, metric: str = "cosine", id_column: str = "id", texts: bool = False) -> DataFrame:
    """Dense and sparse search of the same queries (by qid), fused. A k of 0
    leaves a list out; both at 0 is an error. Distances are turned round
    before linear fusion, so that nearer is higher. texts: as for sparse_knn."""
    if dense_k < 0 or sparse_k < 0 or n < 1 or dense_k + sparse_k == 0:
        raise SearchError("a hybrid search needs a list and a positive number of results")
    none = vectors.select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    dense = knn_batch(vectors, queries, dense_k, metric, id_column=id_column) if dense_k else none
    if not METRICS[metric].similarity:
        dense = dense.withColumn("score", -F.col("score"))
    sparse = sparse_knn(postings, sparse_queries, sparse_k, texts) if sparse_k else none
    return rrf(dense, sparse, n, k) if fusion == "rrf" else linear(dense, sparse, alpha, n)
