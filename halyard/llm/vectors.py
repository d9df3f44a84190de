"""Exact top-k by the threshold algorithm, and near-duplicate vectors by
collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.llm.common import connected_components, lowest_linked, materialize

#: Candidates and queries that meet in one task.
CANDIDATES, QUERIES = 8192, 2048
#: Under every score.
NONE = -(1 << 62)


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def stack(vectors: pa.Array) -> np.ndarray:
    """A list column of one length as a double matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def threshold_top(queries: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Indices and scores of the k highest inner products of each query, ties
    to the smaller index, and how many candidates were scored, query by query.
    Queries and vectors are whole numbers. An index of -1 is none: with
    `least`, a score that a query's kth is known to reach, what is below may
    be left out.

    Fagin's threshold algorithm for many queries at once. Every dimension has
    its candidates sorted by value, and is read from the end that the query's
    sign favours. After reading to a depth, whatever was met is scored, and no
    candidate that was not met can score more than the sum of each dimension's
    value at that depth. A query stops when this bound is below its kth.

    Products are exact: in double precision where no sum of absolute products
    can pass 2 ** 53, and in 64-bit integers beyond."""
    n, d = vectors.shape
    k = min(k, n)
    largest = [max(1.0, float(np.abs(x).max(initial=0))) for x in (queries, vectors)]
    exact = largest[0] * largest[1] * max(1, d) < 2.0**53
    q, v = (queries, vectors) if exact else (queries.astype(np.int64), vectors.astype(np.int64))
    order = np.argsort(vectors, axis=0, kind="stable")
    values = np.take_along_axis(vectors, order, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    best = np.full((len(queries), k), -1, dtype=np.int64)
    scores = np.full((len(queries), k), NONE, dtype=np.int64)
    floor = np.full(len(queries), NONE) if least is None else least
    met = np.zeros(n, dtype=bool)
    active = np.arange(len(queries))
    read, depth, scored = 0, min(n, k), 0
    while len(active):
        # The bound before this depth is read: of all that is not met yet.
        bound = up[active] @ values[n - 1 - min(read, n - 1)] + down[active] @ values[min(read, n - 1)]
        slack = 0 if exact else np.abs(bound) * 1e-9 + 1
        active = active[bound + slack >= np.maximum(scores[active].min(axis=1, initial=np.iinfo(np.int64).max), floor[active])]
        if not len(active) or read >= n:
            break
        now = np.zeros(n, dtype=bool)
        now[order[n - depth : n - read, (queries[active] > 0).any(axis=0)]] = True
        now[order[read:depth, (queries[active] < 0).any(axis=0)]] = True
        if depth == n:
            now[:] = True
        new = np.flatnonzero(now & ~met)
        met |= now
        if len(new):
            scored += len(new) * len(active)
            mine = (q[active] @ v[new].T).astype(np.int64)
            whole = np.concatenate([scores[active], mine], axis=1)
            names = np.concatenate([best[active], np.broadcast_to(new, mine.shape)], axis=1)
            top = ranked(whole, names, k)
            scores[active] = np.take_along_axis(whole, top, axis=1)
            best[active] = np.take_along_axis(names, top, axis=1)
        read, depth = depth, min(n, depth * 2)
    return best, scores, scored


def ranked(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller name."""
    if scores.shape[1] > 4 * k:
        # The kth score, and all that reach it: as many columns as the row with the most.
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        wide = int((scores >= kth).sum(axis=1).max())
        some = np.argpartition(-scores, min(wide, scores.shape[1]) - 1, axis=1)[:, :wide]
    else:
        some = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.lexsort((np.take_along_axis(names, some, axis=1), -np.take_along_axis(scores, some, axis=1)), axis=1)
    return np.take_along_axis(some, order[:, :k], axis=1)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the highest integer
    inner product of each query, ties to the smaller vec_id.

    Both: vec_id long, vector array of whole doubles; sums of absolute products
    are to stay under 2 ** 62, and are exact up to there. A query is never its own
    candidate (same vec_id). Null ids and vectors that are null or hold null
    or non-finite components take no part; vectors meet those of their own
    length. A repeated query id asks once, with its smallest vector; repeated
    candidates are each ranked; an empty table gives none. Queries and candidates meet in blocks of
    bounded size, each block pair in one task, and a block pair sends on at
    most k rows a query."""
    spark = candidates.sparkSession
    queries = queries.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    candidates = candidates.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector")
    # The block number is fixed before rows are repeated for the other side's blocks.
    some = F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("deal")
    queries, candidates = (materialize(t.select("vec_id", "vector", some), name) for t, name in ((queries, "queries"), (candidates, "candidates")))
    q, c = (max(1, -(-t.count() // size)) for t, size in ((queries, QUERIES), (candidates, CANDIDATES)))
    ours = queries.select("vec_id", "vector", F.pmod("deal", F.lit(q).cast("long")).alias("qb"))
    theirs = candidates.select("vec_id", "vector", F.pmod("deal", F.lit(c).cast("long")).alias("cb"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        asks, has = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(asks) and len(has):
            a, b = np.stack(asks["vector"].to_numpy()), np.stack(has["vector"].to_numpy())
            a_id, b_id, least = asks["vec_id"].to_numpy(), has["vec_id"].to_numpy(), asks["least"].to_numpy()
            own = np.searchsorted(b_id, a_id, "right") - np.searchsorted(b_id, a_id)
            for i in range(0, len(a), 256):
                # One more for each row of the query's own id.
                extra = int(own[i : i + 256].max())
                best, score, _ = threshold_top(a[i : i + 256], b, k + extra, least[i : i + 256])
                ids = b_id[best]
                mine = (ids == a_id[i : i + 256, None]) | (best < 0)
                place = np.cumsum(~mine, axis=1)
                keep = ~mine & (place <= k)
                rows, _ = np.nonzero(keep)
                out[0].append(a_id[i : i + 256][rows])
                out[1].append(ids[keep])
                out[2].append(score[keep])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for c, x in zip(("query_id", "vec_id", "score"), out)})

    def met(asks: DataFrame, has: DataFrame, first: int, count: int) -> DataFrame:
        """The best of each block pair, for blocks first to first + count - 1 of the candidates."""
        numbers = lambda a, n: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(a + n - 1).cast("long")))
        asks = asks.select("vec_id", "vector", F.lit(True).alias("ask"), "least", "qb", numbers(first, count).alias("cb"))
        has = has.where(F.col("cb").between(first, first + count - 1)).select("vec_id", "vector", F.lit(False).alias("ask"), F.lit(NONE).alias("least"), numbers(0, q).alias("qb"), "cb")
        both = asks.unionByName(has).withColumn("size", F.size("vector"))
        return both.groupBy("qb", "cb", "size").applyInPandas(meet, "query_id long, vec_id long, score long")

    # A block of the candidates first: its kth score bounds what the others need to read.
    found = met(ours.withColumn("least", F.lit(NONE)), theirs, 0, 1)
    if c > 1:
        found = materialize(found, "first")
        order = W.partitionBy("query_id").orderBy(F.col("score").desc())
        kth = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        ours = ours.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
        found = found.unionByName(met(ours, theirs, 1, c - 1))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Near-duplicate search: the cosine, the recall at exactly that cosine, the
#: width of a projection's cell and half that of a window in distances.
COSINE, RECALL, CELL, WINDOW = 0.9, 0.98, 2.2, 1.5
#: Projections whose windows are counted for a pair.
COUNTED = 32
#: Vectors of a cell that meet in one task, and the cell size aimed at.
BLOCK, CELL_ROWS = 2048, 1500


class Projections:
    """Seeded one-dimensional projections: `count` whose windows are counted,
    and `groups` of `each` that deal vectors to cells.

    For two unit vectors at distance r a projection differs by a normal of
    deviation r. `each` grows with the logarithm of the rows so that cells
    keep their size; `groups` is the least that finds a pair at the limit with
    the wanted recall; `least` is the collision count that all but a
    thousandth of such pairs reach."""

    def __init__(self, rows: int, cosine: float = COSINE, recall: float = RECALL, cell: float = CELL, window: float = WINDOW, count: int = COUNTED) -> None:
        r = math.sqrt(2 - 2 * cosine)
        same = 1 - r * math.sqrt(2 / math.pi) / cell  # both ends of a difference in one cell
        self.cosine, self.cell, self.count = cosine, cell, count
        self.each = max(4, math.ceil(math.log2(max(2, rows) / CELL_ROWS)))
        self.groups = math.ceil(math.log(1 - recall) / math.log1p(-(same**self.each)))
        self.window = math.ceil(window * r * 16) + 1  # in sixteenths, rounding included
        near = math.erf(window / math.sqrt(2))
        self.least, tail = 0, (1 - near) ** count
        while tail <= 0.001:
            self.least += 1
            tail += math.exp(math.lgamma(count + 1) - math.lgamma(self.least + 1) - math.lgamma(count - self.least + 1) + self.least * math.log(near) + (count - self.least) * math.log1p(-near))

    def counted(self, unit: np.ndarray) -> np.ndarray:
        """Projections in sixteenths, a byte each."""
        p = unit @ np.random.default_rng(20240229).standard_normal((self.count, unit.shape[1])).T
        return np.clip(np.round(p * 16) + 128, 0, 255).astype(np.uint8)

    def cells(self, unit: np.ndarray, groups: range | None = None) -> np.ndarray:
        """The key of the cell in each of the groups (all, or the first ones)."""
        groups = groups or range(self.groups)
        out = np.empty((len(unit), len(groups)), dtype=np.uint64)
        for g in groups:
            rng = np.random.default_rng((20240301, g))
            p = unit @ rng.standard_normal((self.each, unit.shape[1])).T
            at = np.floor((p + rng.random(self.each) * self.cell) / self.cell).astype(np.int64).astype(np.uint64)
            key = np.full(len(unit), 0x9E3779B97F4A7C15, dtype=np.uint64)
            for i in range(self.each):
                key = (key ^ at[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            out[:, g] = key
        return out.view(np.int64)


def collisions(a: np.ndarray, b: np.ndarray, window: int, least: int) -> np.ndarray:
    """Pairs whose projections fall in each other's windows `least` times; a
    and b: rows x projections, bytes."""
    hits = np.zeros((len(a), len(b)), dtype=np.uint16 if a.shape[1] > 255 else np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        hits += np.maximum(x[:, None], y) - np.minimum(x[:, None], y) <= window
    return hits >= least


def block_links(p: Projections) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Verified links within a block pair: weights per vector and a star of
    edges per component, not the pairs."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        a_side = pdf[pdf["left"]].reset_index(drop=True)
        inner = bool(pdf["bi"].iloc[0] == pdf["bj"].iloc[0])
        b_side = a_side if inner else pdf[~pdf["left"]].reset_index(drop=True)
        empty = pd.DataFrame({"id": np.zeros(0, dtype=np.int64), "links": np.zeros(0, dtype=np.int64), "root": np.zeros(0, dtype=np.int64)})
        if not len(a_side) or not len(b_side):
            return empty
        group = int(pdf["g"].iloc[0])
        sides = []
        for side in (a_side, b_side):
            x = np.stack(side["vector"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            unit = x / norm[:, None]
            sides.append((x, norm, p.counted(unit), p.cells(unit, range(group)) if group else np.zeros((len(x), 0), dtype=np.int64)))
        (xa, na, pa_, ka), (xb, nb, pb, kb) = sides
        ii, jj = [], []
        for low in range(0, len(xa), 256):
            i, j = np.nonzero(collisions(pa_[low : low + 256], pb, p.window, p.least))
            if inner:
                i, j = i[i + low < j], j[i + low < j]
            if not len(i):
                continue
            if len(i) > 0.05 * 256 * len(xb):
                cosine = (xa[low : low + 256] @ xb.T)[i, j]
            else:
                cosine = np.concatenate([np.einsum("ij,ij->i", xa[low + i[s : s + 50_000]], xb[j[s : s + 50_000]]) for s in range(0, len(i), 50_000)])
            close = cosine / (na[low + i] * nb[j]) >= p.cosine
            i, j = i[close] + low, j[close]
            # A pair counts in the first group whose cell it shares.
            new = ~(ka[i] == kb[j]).any(axis=1)
            ii.append(i[new])
            jj.append(j[new])
        if not ii or not sum(map(len, ii)):
            return empty
        i, j = np.concatenate(ii), np.concatenate(jj)
        ids = np.r_[a_side["id"].to_numpy(), b_side["id"].to_numpy()] if not inner else a_side["id"].to_numpy()
        mult = np.r_[a_side["copies"].to_numpy(), b_side["copies"].to_numpy()] if not inner else a_side["copies"].to_numpy()
        j = j if inner else j + len(a_side)
        weight = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
        order = np.argsort(ids, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        root = ids[order][lowest_linked(len(ids), back[i], back[j])][back]
        some = weight > 0
        return pd.DataFrame({"id": ids[some], "links": weight[some].astype(np.int64), "root": root[some]})

    return links


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id,
    embedding; other columns are ignored).

    Links join rows whose cosine, in double precision, is `cosine` or more;
    none is reported below that, and a pair exactly there is found with the
    given probability (nearer pairs with more). Equal vectors are one vector
    with a count, so a vector that a third of all rows share is one row.
    Vectors that are null, empty, all zero, or hold null or non-finite
    components, and rows without an id, link with nothing. component_id is the
    smallest linked vec_id; kept: the row's vec_id is its component's."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fit = F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = materialize(rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("hash", F.xxhash64("vector")), "vectors")
    distinct = materialize(rows.where("fit").groupBy("hash", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "distinct")
    p = Projections(distinct.count(), cosine, recall)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == n))
                x = stack(part.column(1))
                key = p.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, p.groups, dtype=np.int32), key.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=["id", "vector", "copies", "keys"])

    kind = distinct.schema["vector"].dataType.simpleString()
    placed = distinct.select("id", "vector", "copies").mapInArrow(project, f"id long, vector {kind}, copies long, keys array<long>")
    placed = materialize(placed, "projected")
    cells = placed.select("id", F.size("vector").alias("size"), F.posexplode("keys").alias("g", "cell"))
    sizes = cells.groupBy("g", "cell", "size").agg(F.count("*").alias("n")).where("n > 1")
    each = placed.select("id", "vector", "copies", F.size("vector").alias("size"), F.posexplode("keys").alias("g", "cell")).join(sizes, ["g", "cell", "size"])
    each = each.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("b", F.pmod(F.xxhash64("id", "g"), F.col("blocks")))
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj"))))
    dealt = each.withColumn("meet", meets).select("id", "vector", "copies", "g", "cell", "size", "meet.bi", "meet.bj", (F.col("b") == F.col("meet.bi")).alias("left"))
    found = dealt.groupBy("g", "cell", "size", "bi", "bj").applyInPandas(block_links(p), "id long, links long, root long")
    found = materialize(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    members = distinct.select("hash", "vector", "id", "copies").join(counts, "id", "left").join(components, "id", "left")
    members = members.select("hash", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    linked = rows.where("fit").join(members, ["hash", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
