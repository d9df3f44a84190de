"""A collection of vectors and its maintenance.

State is a DataFrame of id, vector, metadata columns and a tombstone. Every
operation returns a new collection with its plan added, so a chain of changes
is one job; `materialize` or `save` cuts it. Ids are the caller's and are kept
through compaction."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions.vector import METRICS, finite
from halyard.operators import search
from halyard.operators.metadata import check_key
from halyard.plans.ast import Filter

TOMBSTONE = "deleted"
#: Shares of tombstones over which a collection wants compaction.
COMPACT_OVER, LEAST_THRESHOLD, MOST_THRESHOLD = 0.30, 0.01, 0.99
MAX_BATCH_DELETE = 10_000_000


class CollectionError(ValueError):
    pass


@dataclass(frozen=True)
class Collection:
    rows: DataFrame
    dimensions: int
    metric: str = "l2"
    id_column: str = "id"
    vector_column: str = "embedding"
    compact_over: float = COMPACT_OVER

    @classmethod
    def create(cls, rows: DataFrame, dimensions: int, metric: str = "l2", id_column: str = "id", vector_column: str = "embedding", compact_over: float = COMPACT_OVER) -> Collection:
        if metric not in METRICS:
            raise CollectionError(f"no metric {metric}")
        if dimensions < 1:
            raise CollectionError("dimensions must be positive")
        for c in rows.columns:
            if c not in (id_column, vector_column, TOMBSTONE):
                check_key(c)
        if TOMBSTONE not in rows.columns:
            rows = rows.withColumn(TOMBSTONE, F.lit(False))
        return cls(rows, dimensions, metric, id_column, vector_column, min(MOST_THRESHOLD, max(LEAST_THRESHOLD, compact_over)))

    def _with(self, rows: DataFrame) -> Collection:
        return replace(self, rows=rows)

    # Reading.
    def live(self) -> DataFrame:
        return self.rows.where(~F.col(TOMBSTONE)).drop(TOMBSTONE)

    def get(self, id_: int) -> DataFrame:
        return self.live().where(F.col(self.id_column) == id_)

    def contains(self, id_: int) -> bool:
        return not self.get(id_).isEmpty()

    def is_deleted(self, id_: int) -> bool:
        return not self.rows.where((F.col(self.id_column) == id_) & F.col(TOMBSTONE)).isEmpty()

    # Writing.
    def valid(self, new: DataFrame) -> DataFrame:
        return new.where(F.col(self.id_column).isNotNull() & (F.col(self.id_column) > 0) & finite(F.col(self.vector_column), self.dimensions))

    def insert(self, new: DataFrame) -> Collection:
        """Append rows; fails as a whole if one is not valid or its id is taken."""
        bad = new.count() - self.valid(new).count()
        if bad:
            raise CollectionError(f"{bad} rows have no id, wrong dimensions, or NaN or infinity")
        taken = new.groupBy(self.id_column).count().where("count > 1").unionByName(new.join(self.rows.select(self.id_column), self.id_column, "left_semi").groupBy(self.id_column).count())
        if not taken.isEmpty():
            raise CollectionError("an id is taken")
        return self._with(self._append(new))

    def _append(self, new: DataFrame) -> DataFrame:
        return self.rows.unionByName(new.withColumn(TOMBSTONE, F.lit(False)), allowMissingColumns=True)

    def batch_new(self, new: DataFrame, ordinal: str) -> DataFrame:
        """The rows of a batch that it inserts: valid ones, the first of an id
        in the order of `ordinal`, whose id is not there yet."""
        order = W.partitionBy(self.id_column).orderBy(ordinal)
        first = self.valid(new).withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_", ordinal)
        return first.join(self.rows.select(self.id_column), self.id_column, "left_anti")

    def batch_insert(self, new: DataFrame, ordinal: str) -> Collection:
        """Append what can be; the batch fails if its first vector has the
        wrong length."""
        first = new.orderBy(ordinal).select(F.size(self.vector_column).alias("n")).first()
        if first and first["n"] != self.dimensions:
            raise CollectionError(f"the first vector has {first['n']} dimensions, the collection {self.dimensions}")
        return self._with(self._append(self.batch_new(new, ordinal)))

    def delete(self, ids: DataFrame) -> Collection:
        """Tombstone ids (one column, the id). Metadata goes with them."""
        marked = ids.select(F.col(ids.columns[0]).alias(self.id_column)).distinct().withColumn("gone_", F.lit(True))
        rows = self.rows.join(marked, self.id_column, "left")
        gone = F.coalesce("gone_", F.lit(False))
        kept = (self.id_column, self.vector_column, TOMBSTONE)
        return self._with(rows.select(*[F.when(~gone, F.col(c)).alias(c) if c not in kept else (F.col(c) | gone).alias(c) if c == TOMBSTONE else F.col(c) for c in self.rows.columns]))

    def delete_report(self, ids: DataFrame) -> DataFrame:
        """total, unique, deleted, already_deleted, invalid of a batch of ids."""
        wanted = ids.select(F.col(ids.columns[0]).alias(self.id_column))
        n = wanted.count()
        if n > MAX_BATCH_DELETE:
            raise CollectionError(f"over {MAX_BATCH_DELETE} ids")
        found = wanted.distinct().join(self.rows.select(self.id_column, TOMBSTONE), self.id_column, "left")
        return found.agg(
            F.lit(n).cast("long").alias("total"),
            F.count("*").alias("unique"),
            F.count_if(~F.col(TOMBSTONE)).alias("deleted"),
            F.count_if(TOMBSTONE).alias("already_deleted"),
            F.count_if(F.col(TOMBSTONE).isNull()).alias("invalid"),
        )

    def restore(self, ids: DataFrame) -> Collection:
        back = ids.select(F.col(ids.columns[0]).alias(self.id_column)).distinct().withColumn("back_", F.lit(True))
        rows = self.rows.join(back, self.id_column, "left")
        return self._with(rows.withColumn(TOMBSTONE, F.col(TOMBSTONE) & F.col("back_").isNull()).select(*self.rows.columns))

    def set_metadata(self, changes: DataFrame) -> Collection:
        """Columns of changes (id and metadata columns) replace or add values;
        a null leaves a value as it is."""
        names = [c for c in changes.columns if c != self.id_column]
        for c in names:
            check_key(c)
        new = changes.select(self.id_column, *[F.col(c).alias(f"{c}_new") for c in names])
        rows = self.rows.join(new, self.id_column, "left")
        own = [F.coalesce(f"{c}_new", c).alias(c) if c in names else F.col(c) for c in self.rows.columns]
        return self._with(rows.select(*own, *[F.col(f"{c}_new").alias(c) for c in names if c not in self.rows.columns]))

    def compact(self) -> Collection:
        """Without tombstones; ids and metadata stay."""
        return self._with(self.rows.where(~F.col(TOMBSTONE)))

    # Counts.
    def stats(self) -> DataFrame:
        """total, live, deleted, tombstone_ratio, dimensions, vector_bytes."""
        gone = F.count_if(TOMBSTONE)
        return self.rows.agg(
            F.count("*").alias("total"),
            F.count_if(~F.col(TOMBSTONE)).alias("live"),
            gone.alias("deleted"),
            F.when(F.count("*") > 0, gone / F.count("*")).otherwise(F.lit(0.0)).alias("tombstone_ratio"),
            F.lit(self.dimensions).alias("dimensions"),
            (F.count("*") * 4 * self.dimensions).alias("vector_bytes"),
        )

    def needs_compaction(self) -> bool:
        return self.stats().first()["tombstone_ratio"] > self.compact_over

    def compaction_warning(self) -> str | None:
        ratio = self.stats().first()["tombstone_ratio"]
        return f"{ratio:.0%} of the rows are deleted, over {self.compact_over:.0%}; compact the collection" if ratio > self.compact_over else None

    # Searching.
    def _names(self) -> dict[str, Any]:
        return {"id_column": self.id_column, "vector_column": self.vector_column}

    def search(self, query: list[float], k: int, where: str | Filter | None = None, include: list[str] | None = None) -> DataFrame:
        return search.knn(self.live(), query, k, self.metric, where, include=include, dimensions=self.dimensions, **self._names())

    def search_batch(self, queries: DataFrame, k: int, where: str | Filter | None = None) -> DataFrame:
        return search.knn_batch(self.live(), queries, k, self.metric, where, **self._names())

    def search_filtered(self, query: list[float], k: int, where: str | Filter | None) -> search.FilteredResult:
        return search.filtered_search(self.live(), query, k, where, self.metric, **self._names())

    def search_boosted(self, query: list[float], k: int, boosts: list[search.Boost], where: str | Filter | None = None, candidate_pool: int | None = None) -> DataFrame:
        return search.boosted(self.live(), query, k, boosts, self.metric, where, candidate_pool=candidate_pool, **self._names())

    def search_codes(self, query: list[float], k: int, where: str | Filter | None = None) -> DataFrame:
        return search.code_knn(self.live(), query, k, where, **self._names())

    def search_rescored(self, query: list[float], k: int, factor: int = 5, where: str | Filter | None = None) -> DataFrame:
        return search.rescored_knn(self.live(), query, k, factor, where, **self._names())

    def count(self, where: str | Filter | None = None) -> int:
        return search.count(self.live(), where)
