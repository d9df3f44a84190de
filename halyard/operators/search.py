"""Nearest-neighbour search: exact, batched, filtered, boosted, by codes.

A search of one query is a projection and `orderBy(score, id).limit(k)`, which
Spark runs as a bounded heap per task (TakeOrderedAndProject). A batch of
queries runs as matrix products in an Arrow kernel that sends on k rows per
query and task. Filters come first, so a search returns k rows wherever k
match; ties go to the smaller id."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions import codes
from halyard.functions.vector import METRICS, finite, lit_vector, l2_squared, rescored_similarity
from halyard.plans.ast import Filter
from halyard.plans.bind import EPSILON, Fields, evaluate, keep, operand, tree_of
from halyard.plans.ast import field, literal
from halyard.plans.estimate import Strategy, always, choose_strategy, exact_share, never, sampled_share

#: Bytes of queries that go to every task; more are dealt to block pairs.
QUERY_BYTES = 32 << 20
#: Postings of sparse queries that go to every task; more are dealt to block pairs.
SPARSE_POSTINGS = 3 << 20
#: Scores, and products of light terms, worked on at once; a term that this
#: share of the queries has is a column of a matrix.
CELLS, HEAVY = 1 << 22, 0.05
#: Decimal places that scores of a batch are ranked by: equal vectors must tie,
#: whatever the order in which a matrix product adds.
PLACES = 12
#: Rows of a block where queries or pairs meet vectors block by block.
BLOCK = 4096


class SearchError(ValueError):
    pass


def _check(k: int, query: list[float] | None = None, dimensions: int | None = None) -> None:
    if k < 1:
        raise SearchError("k must be positive")
    if query is not None:
        if dimensions is not None and len(query) != dimensions:
            raise SearchError(f"the query has {len(query)} dimensions, the collection {dimensions}")
        if not np.isfinite(np.asarray(query, dtype=float)).all():
            raise SearchError("the query holds NaN or infinity")


def ranked(rows: DataFrame, score: Column, k: int, descending: bool, id_column: str = "id") -> DataFrame:
    """The k best rows by score, ties to the smaller id."""
    found = rows.withColumn("score", score).where(F.col("score").isNotNull())
    return found.orderBy(F.col("score").desc() if descending else F.col("score").asc(), id_column).limit(k)


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", where: str | Filter | None = None, id_column: str = "id", vector_column: str = "embedding", include: list[str] | None = None, dimensions: int | None = None) -> DataFrame:
    """(id, score, and the columns of `include`) of the k nearest vectors among
    those that match `where`. Vectors of another length never match."""
    _check(k, query, dimensions)
    m = METRICS[metric]
    rows = keep(vectors, where).where(F.size(vector_column) == len(query))
    found = ranked(rows, m.expression(F.col(vector_column), lit_vector(query)), k, m.similarity, id_column)
    return found.select(id_column, "score", *(include or []))


def count(vectors: DataFrame, where: str | Filter | None = None) -> int:
    return keep(vectors, where).count()


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, as SQL's round; numbers too large for it as they are."""
    scale = 10.0**places
    return np.where(np.abs(x) < 2.0**52 / scale, np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x), x)


class _Best:
    """The k highest values of each of n queries and their ids, ties to the
    smaller id, as blocks of rows come by."""

    def __init__(self, n: int, k: int, over: float = -np.inf) -> None:
        self.n, self.k = n, k
        self.q, self.ids, self.values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        #: What a value must reach, and be over `over`.
        self.least, self.over = np.full(n, -np.inf), over

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """values: a row per query, a column per id."""
        hit = (values >= self.least[:, None]) & (values > self.over)
        if values.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * self.n:
            hit &= values >= np.partition(values, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        q, own, value = np.r_[self.q, i], np.r_[self.ids, ids[j]], np.r_[self.values, values[i, j]]
        order = np.lexsort((own, -value, q))
        first = np.searchsorted(q[order], np.arange(self.n + 1))
        place = np.arange(len(q)) - first[:-1][q[order]]
        order = order[place < self.k]
        self.q, self.ids, self.values = q[order], own[order], value[order]
        full = np.flatnonzero(np.bincount(self.q, minlength=self.n) == self.k)
        self.least[full] = self.values[np.searchsorted(self.q, full) + self.k - 1]

    def rows(self, names: np.ndarray, sign: float = 1.0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[self.q]), pa.array(self.ids), pa.array(sign * self.values)], names=["qid", "id", "score"])


def _kernel(queries: np.ndarray, names: np.ndarray, k: int, metric: str, places: int):  # noqa: ANN202
    m = METRICS[metric]
    sign = 1.0 if m.similarity else -1.0
    block = max(64, min(BLOCK, CELLS // max(1, len(queries))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries), k)
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(size == queries.shape[1]))
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                best.add(sign * _rounded(m.matrix(queries, x), places), ids)
        if len(best.q):
            yield best.rows(names, sign)

    return scan


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: str | Filter | None = None, id_column: str = "id", vector_column: str = "embedding", exclude_self: bool = False, places: int = PLACES) -> DataFrame:
    """(qid, id, score, rank) of the k nearest vectors of every query, by the
    score rounded to so many places, ties to the smaller id.

    queries: qid and embedding. Queries under QUERY_BYTES together are sent to
    every task; others meet the vectors in pairs of blocks, each in one task.
    Either way a task sends on k rows per query, and the rest is a rank within
    each query, bounded before its shuffle."""
    _check(k)
    rows = keep(vectors, where).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("embedding")).where(finite(F.col("embedding")))
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")).where(finite(F.col("embedding")))
    n, size = queries.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    take = k + 1 if exclude_self else k
    if 8 * (size or 0) <= QUERY_BYTES:
        found = None
        by_size: dict[int, list] = {}
        for r in queries.collect():
            by_size.setdefault(len(r["embedding"]), []).append((r["qid"], r["embedding"]))
        for group in by_size.values():
            scan = _kernel(np.array([v for _, v in group]), np.array([q for q, _ in group], dtype=np.int64), take, metric, places)
            part = rows.mapInArrow(scan, "qid long, id long, score double")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = rows.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score")).limit(0)
    else:
        found = _block_search(rows, queries, n, take, metric, places)
    if exclude_self:
        found = found.where("qid <> id")
    order = W.partitionBy("qid").orderBy(F.col("score").desc() if METRICS[metric].similarity else F.col("score").asc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_search(rows: DataFrame, queries: DataFrame, n: int, k: int, metric: str, places: int) -> DataFrame:
    blocks = -(-n // BLOCK)
    total = max(1, -(-rows.count() // (4 * BLOCK)))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m).cast("long"))
    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    ours = queries.select(deal("qid", blocks).alias("qb"), "qid", "embedding", spread(total).alias("vb"))
    theirs = rows.select(deal("id", total).alias("vb"), "id", "embedding", spread(blocks).alias("qb"))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, group in q.groupby(q["embedding"].map(len)):
            batch = pa.RecordBatch.from_arrays([pa.array(v["id"]), pa.array(v["embedding"].tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])
            scan = _kernel(np.stack(group["embedding"].to_numpy()), group["qid"].to_numpy(), k, metric, places)
            out += [b.to_pandas() for b in scan(iter([batch]))]
        return pd.concat(out) if out else pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return ours.groupBy("qb", "vb").cogroup(theirs.groupBy("qb", "vb")).applyInPandas(meet, "qid long, id long, score double")


def pairs_above(vectors: DataFrame, threshold: float, metric: str = "cosine", id_column: str = "id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id1, id2, score) of all pairs, id1 < id2, that score over a threshold
    (under it, for distances). Blocks of vectors meet once each."""
    m = METRICS[metric]
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(finite(F.col("v")))
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")))
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda o: F.struct(F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj"))))
    dealt = dealt.withColumn("m", meets).select("id", "v", F.size("v").alias("n"), "m.bi", "m.bj", "b")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        i_side = pdf[pdf["b"] == pdf["bi"]]
        j_side = pdf[pdf["b"] == pdf["bj"]]
        if not len(i_side) or not len(j_side):
            return pd.DataFrame({"id1": pd.Series(dtype="int64"), "id2": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        score = m.matrix(np.stack(i_side["v"].to_numpy()), np.stack(j_side["v"].to_numpy()))
        a, b = i_side["id"].to_numpy(), j_side["id"].to_numpy()
        hit = score > threshold if m.similarity else score < threshold
        hit &= a[:, None] < b[None, :] if pdf["bi"].iloc[0] == pdf["bj"].iloc[0] else a[:, None] != b[None, :]
        i, j = np.nonzero(hit)
        return pd.DataFrame({"id1": np.minimum(a[i], b[j]), "id2": np.maximum(a[i], b[j]), "score": score[i, j]})

    return dealt.groupBy("n", "bi", "bj").applyInPandas(meet, "id1 long, id2 long, score double")


@dataclass(frozen=True)
class FilteredResult:
    """rows, and what a filtered search says about itself."""

    rows: DataFrame
    complete: bool
    strategy: str
    observed_selectivity: float
    vectors_evaluated: int


def filtered_search(vectors: DataFrame, query: list[float], k: int, where: str | Filter | None = None, metric: str = "l2", id_column: str = "id", vector_column: str = "embedding", strategy: Strategy | None = None) -> FilteredResult:
    """A filtered search with its diagnostics. complete is true when k rows
    are found, or when the form of the filter tells that there are none.

    Without a strategy, or with auto or pre, Spark filters before it ranks and
    finds k rows wherever k match; without one or with auto, the result's
    strategy says what an index that cannot would have done. post ranks first and filters the
    k * oversample nearest; hybrid does so with its low factor, and with its
    high one where the first gives fewer than k. Both can find fewer than k."""
    tree = tree_of(where)
    if strategy is not None and strategy.check().name in ("post", "hybrid") and not never(tree):
        return _ranked_first(vectors, query, k, tree, metric, id_column, vector_column, strategy)
    rows = knn(vectors, query, k, metric, where, id_column, vector_column)
    total, passed, _ = exact_share(vectors, tree).first()
    if not total or never(tree):
        return FilteredResult(rows, True, "none", 0.0, 0)
    if strategy is not None and strategy.name == "pre":
        name = "pre"
    else:
        name = "none" if always(tree) else choose_strategy(sampled_share(vectors, tree).share).name
    return FilteredResult(rows, passed >= k, name, passed / total, passed)


def _ranked_first(vectors: DataFrame, query: list[float], k: int, tree: Filter, metric: str, id_column: str, vector_column: str, strategy: Strategy) -> FilteredResult:
    marked = vectors.withColumn("passes_", F.coalesce(evaluate(vectors, tree), F.lit(False)))
    factors = [strategy.oversample] if strategy.name == "post" else [strategy.low, strategy.high]
    for factor in factors:
        near = knn(marked, query, math.ceil(k * factor), metric, None, id_column, vector_column, ["passes_"])
        seen, passed = near.agg(F.count("*"), F.count_if("passes_")).first()
        if passed >= k:
            break
    found = ranked(near.where("passes_"), F.col("score"), k, METRICS[metric].similarity, id_column)
    return FilteredResult(found.select(id_column, "score"), passed >= k, strategy.name, passed / seen if seen else 0.0, seen)


@dataclass(frozen=True)
class Boost:
    """A weight for rows whose field equals a value; a string also matches an
    element of an array."""

    field: str
    value: str | int | float | bool
    weight: float

    def __post_init__(self) -> None:
        if not self.field:
            raise SearchError("a boost needs a field")
        if not np.isfinite(self.weight):
            raise SearchError("a boost's weight must be finite")


def boost_factor(df: DataFrame, boosts: list[Boost]) -> Column:
    """The sum of the weights that match, from -1 to 0.99."""
    total = F.lit(0.0)
    fields = Fields(df)
    for b in boosts:
        own, wanted = operand(field(b.field), fields), operand(literal(b.value), fields)
        if own.kind == "array" and wanted.kind == "string":
            match = F.array_contains(own.column, wanted.column)
        elif own.numeric and wanted.numeric:
            match = F.abs(own.column.cast("double") - wanted.column.cast("double")) < EPSILON
        else:
            match = own.column == wanted.column if own.kind == wanted.kind else F.lit(False)
        total = total + F.when(match, F.lit(float(b.weight))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(0.99), total))


def boosted(vectors: DataFrame, query: list[float], k: int, boosts: list[Boost], metric: str = "l2", where: str | Filter | None = None, id_column: str = "id", vector_column: str = "embedding", candidate_pool: int | None = None) -> DataFrame:
    """(id, distance, score): the k rows of the least boosted distance,
    distance * (1 - factor). All rows are boosted; with candidate_pool, only
    so many of the nearest (0: three times k, from 50 to 500)."""
    _check(k, query)
    m = METRICS[metric]
    distance = m.expression(F.col(vector_column), lit_vector(query))
    distance = 1 - distance if m.similarity else distance
    rows = keep(vectors, where).where(F.size(vector_column) == len(query)).withColumn("distance", distance)
    if candidate_pool is not None:
        rows = rows.orderBy("distance", id_column).limit(candidate_pool or min(500, max(50, 3 * k)))
    score = F.col("distance") * (1 - boost_factor(vectors, boosts)) if boosts else F.col("distance")
    return ranked(rows, score, k, False, id_column).select(id_column, "distance", "score")


def binary_knn(rows: DataFrame, query: bytes, k: int, where: str | Filter | None = None, id_column: str = "id", code_column: str = "code") -> DataFrame:
    """(id, score) by Hamming distance of packed binary codes; k = 0 gives
    none. Codes of another length never match."""
    words = codes.words_of_bytes(F.lit(bytearray(query)), len(query))
    rows = keep(rows, where).where(F.octet_length(code_column) == len(query))
    score = codes.hamming(codes.words_of_bytes(F.col(code_column), len(query)), words)
    return ranked(rows, score, k, False, id_column).select(id_column, "score")


def _signs(query: list[float]) -> Column:
    words = []
    for low in range(0, len(query), 64):
        word = sum(1 << i for i, x in enumerate(query[low : low + 64]) if x > 0)
        words.append(word - (1 << 64) if word >= 1 << 63 else word)
    return F.array(*[F.lit(w).cast("long") for w in words])


def code_knn(vectors: DataFrame, query: list[float], k: int, where: str | Filter | None = None, id_column: str = "id", vector_column: str = "embedding", code: Column | None = None) -> DataFrame:
    """(id, score) by similarity of sign codes, 1 - Hamming / dimensions.
    code: a stored column of words, else derived from the vectors."""
    _check(k, query)
    own = code if code is not None else codes.sign_words(F.col(vector_column), len(query))
    rows = keep(vectors, where)
    score = codes.bit_similarity(codes.hamming(own, _signs(query)), len(query))
    return ranked(rows, score, k, True, id_column).select(id_column, "score")


def rescored_knn(vectors: DataFrame, query: list[float], k: int, factor: int = 5, where: str | Filter | None = None, id_column: str = "id", vector_column: str = "embedding", code: Column | None = None) -> DataFrame:
    """(id, score): the k * factor best by sign codes, ranked again by exact
    distance, 1 / (1 + L2 squared). The first stage keeps ids only where codes
    are stored; vectors are then joined for a few rows."""
    _check(k, query)
    if factor < 1:
        raise SearchError("the factor must be positive")
    first = code_knn(vectors, query, k * factor, where, id_column, vector_column, code).select(id_column)
    rows = vectors.join(F.broadcast(first), id_column)  # k * factor rows
    score = rescored_similarity(l2_squared(F.col(vector_column), lit_vector(query)))
    return ranked(rows, score, k, True, id_column).select(id_column, "score")


def scalar_knn(vectors: DataFrame, query: list[float], k: int, low: float, high: float, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(id, score) by squared distance of scalar codes, in code units."""
    _check(k, query)
    own = codes.scalar_encode(F.col(vector_column), low, high)
    theirs = codes.scalar_encode(lit_vector(query), low, high)
    return ranked(vectors, codes.scalar_l2_squared(own, theirs), k, False, id_column).select(id_column, "score")


class SparseQueries:
    """Sparse queries in a task: heavy terms as rows of a matrix, the others
    as lists of queries."""

    def __init__(self, rows: pa.Table) -> None:
        coded = rows["term"].combine_chunks().dictionary_encode()
        self.terms = coded.dictionary
        term, weight = coded.indices.to_numpy().astype(np.int64), rows["weight"].to_numpy()
        self.names, q = np.unique(rows["qid"].to_numpy(), return_inverse=True)
        self.norms = np.sqrt(np.bincount(q, weight * weight, len(self.names)))
        times = np.bincount(term, minlength=len(self.terms))
        heavy = times >= max(2, HEAVY * len(self.names))
        self.column = np.where(heavy, np.cumsum(heavy) - 1, -1)
        self.matrix = np.zeros((int(heavy.sum()), len(self.names)))
        own = heavy[term]
        np.add.at(self.matrix, (self.column[term[own]], q[own]), weight[own])
        term, q, weight = term[~own], q[~own], weight[~own]
        order = np.argsort(term, kind="stable")
        self.q, self.weight = q[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Dot products, a row per query; row: from 0 to n - 1."""
        column = self.column[term]
        own = column >= 0
        width = len(self.matrix)
        found = np.bincount(row[own] * width + column[own], weight[own], n * width).reshape(n, width) @ self.matrix
        row, term, weight = row[~own], term[~own], weight[~own]
        times = self.first[term + 1] - self.first[term]
        ends = np.r_[0, np.cumsum(times)]
        low = 0
        while low < len(term):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + CELLS, "right")) - 1)
            at = np.repeat(self.first[term[low:high]] - ends[low:high], times[low:high]) + np.arange(ends[low], ends[high])
            cell = np.repeat(row[low:high] * len(self.names), times[low:high]) + self.q[at]
            found += np.bincount(cell, np.repeat(weight[low:high], times[low:high]) * self.weight[at], found.size).reshape(found.shape)
            low = high
        return found.T

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, their norms, and the scores of all queries, from rows (id,
        term, weight) in the order of their ids."""
        most = max(16, CELLS // max(1, len(self.names)))
        held: list[pa.RecordBatch] = []

        def close(ids: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Iterator[tuple]:
            names, first = np.unique(ids, return_index=True)
            ends = np.r_[first, len(ids)]
            for low in range(0, len(names), most):
                part = slice(ends[low], ends[min(low + most, len(names))])
                n = min(most, len(names) - low)
                row = np.searchsorted(names[low : low + n], ids[part])
                t, w = term[part], weight[part]
                known = t >= 0
                yield names[low : low + n], np.sqrt(np.bincount(row, w * w, n)), self.scores(row[known], t[known], w[known], n)

        def looked_up(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # One lookup for all that is held: each builds a table of all terms.
            term = pc.fill_null(pc.index_in(rows.column(1).cast(self.terms.type), value_set=self.terms), -1)
            return rows.column(0).to_numpy(), term.to_numpy().astype(np.int64), rows.column(2).to_numpy()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(h.num_rows for h in held) >= SPARSE_ROWS and held[0].column(0)[0].as_py() != batch.column(0)[-1].as_py():
                rows = pa.Table.from_batches(held)
                ids = rows.column(0).to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))  # the last id may go on
                yield from close(*looked_up(rows.slice(0, cut)))
                held = rows.slice(cut).to_batches()
        if held:
            yield from close(*looked_up(pa.Table.from_batches(held)))


#: Postings that a task gathers before it scores them.
SPARSE_ROWS = 1 << 18
_POSTING = pa.schema([("id", pa.int64()), ("term", pa.string()), ("weight", pa.float64())])
_SCORED = "qid long, id long, score double"


def _highest(queries: SparseQueries, k: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.names), k, over=0.0)
        for ids, _, scores in queries.blocks(batches):
            best.add(scores, ids)
        yield best.rows(queries.names)

    return scan


def _over(queries: SparseQueries, least: float):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, norms, scores in queries.blocks(batches):
            with np.errstate(invalid="ignore", divide="ignore"):
                value = scores / (norms[None, :] * queries.norms[:, None])
            i, j = np.nonzero((value > least) & (scores != 0))
            yield pa.RecordBatch.from_arrays([pa.array(queries.names[i]), pa.array(ids[j]), pa.array(value[i, j])], names=["qid", "id", "score"])

    return scan


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (id, term, weight) from rows (id, text in lower case) in the
    order of their ids: a term is a run of a-z, its weight how often it stands
    in the texts of its id."""
    find = re.compile("[a-z]+").findall
    ids: list[int] = []
    sizes: list[int] = []
    terms: list[str] = []
    weights: list[int] = []
    last, seen = None, Counter()

    def end() -> None:
        if seen:
            ids.append(last)
            sizes.append(len(seen))
            terms.extend(seen.keys())
            weights.extend(seen.values())

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=np.int64), sizes)), pa.array(terms, pa.string()), pa.array(np.array(weights, dtype=np.float64))], schema=_POSTING)
        for column in (ids, sizes, terms, weights):
            column.clear()
        return out

    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if own != last:
                end()
                last, seen = own, Counter()
                if len(terms) >= SPARSE_ROWS:
                    yield flush()
            seen.update(find(text.as_py()))
    end()
    if terms:
        yield flush()


def _scan_sparse(postings: DataFrame, query: DataFrame, job, argument: float, texts: bool = False) -> DataFrame:  # noqa: ANN001
    """job(queries, argument) over all postings, those of an id together.
    texts: postings are (id, text), whose terms are counted where they are
    scored, so that no row per term goes between Spark and Python.

    A join on the term would make a row for every term that an id shares with
    a query; here products are added where they arise, and no pair is shuffled.
    Queries of up to SPARSE_POSTINGS terms go to every task; more are dealt,
    as the postings are, to pairs of blocks."""
    kind = "string" if texts or postings.schema["term"].dataType != query.schema["term"].dataType else query.schema["term"].dataType
    usable = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") != float("inf"))
    of = lambda rows, name: rows.select(F.col(name).cast("long").alias(name), F.col("term").cast(kind).alias("term"), F.col("weight").cast("double").alias("weight")).where(usable & F.col(name).isNotNull())
    if texts:
        rows = postings.select(F.col("id").cast("long").alias("id"), F.lower("text").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").repartition("id").sortWithinPartitions("id")
    else:
        rows = of(postings, "id")
    query = of(query, "qid").where("term IS NOT NULL")
    n = query.count()
    if not n:
        return rows.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score")).limit(0)
    if n <= SPARSE_POSTINGS and texts:
        scan = job(SparseQueries(query.toArrow()), argument)
        return rows.mapInArrow(lambda batches: scan(term_counts(batches)), _SCORED)
    if n <= SPARSE_POSTINGS:
        # A window asks for the rows of an id together and sorted, without a
        # shuffle where they are dealt by id already.
        together = rows.withColumn("n_", F.row_number().over(W.partitionBy("id").orderBy("id")))
        return together.mapInArrow(job(SparseQueries(query.toArrow()), argument), _SCORED)
    if texts:
        rows = rows.mapInArrow(term_counts, "id long, term string, weight double")
    blocks, total = -(-n // SPARSE_POSTINGS), -(-rows.count() // SPARSE_POSTINGS)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m).cast("long"))
    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    ours = query.select(deal("qid", blocks).alias("qb"), "qid", "term", "weight", spread(max(1, total)).alias("vb"))
    theirs = rows.select(deal("id", max(1, total)).alias("vb"), "id", "term", "weight", spread(blocks).alias("qb"))

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and v.num_rows:
            v = v.select(["id", "term", "weight"]).sort_by("id")
            out = list(job(SparseQueries(q), argument)(iter(v.to_batches())))
        return pa.Table.from_batches(out, pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return ours.groupBy("qb", "vb").cogroup(theirs.groupBy("qb", "vb")).applyInArrow(meet, _SCORED)


def sparse_knn(postings: DataFrame, query: DataFrame, k: int, texts: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k rows of the highest dot product with each
    sparse query, over 0 only; k = 0 gives none.

    postings: id, term, weight. query: qid, term, weight. Weights that are null
    or not finite take no part. A task sends on k rows per query. texts:
    postings are (id, text) instead, terms their runs of a-z in lower case and
    weights how often each stands there."""
    if not k:
        return _scan_sparse(postings, query.limit(0), _highest, 0, texts).withColumn("rank", F.lit(0))
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return _scan_sparse(postings, query, _highest, k, texts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_above(postings: DataFrame, query: DataFrame, least: float) -> DataFrame:
    """(qid, id, score): all rows whose cosine with a sparse query is over
    `least`, which is 0 or more; columns as for sparse_knn."""
    if least < 0:
        raise SearchError("the least cosine must not be negative")
    return _scan_sparse(postings, query, _over, least)
