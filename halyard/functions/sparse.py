"""Sparse vectors: (indices, values, dim) structs, and postings.

A struct's indices ascend strictly and lie under dim. A collection at rest is
better kept as postings (id, term, weight), so that a query only meets the
rows that share its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "struct<indices:array<bigint>,values:array<double>,dim:bigint>"


def sparse(indices: Column, values: Column, dim: Column | int) -> Column:
    dim = F.lit(dim) if isinstance(dim, int) else dim
    return F.struct(indices.cast("array<bigint>").alias("indices"), values.cast("array<double>").alias("values"), dim.cast("bigint").alias("dim"))


def from_pairs(pairs: Column, dim: int) -> Column:
    """From an array of (index, value) structs in any order."""
    ordered = F.array_sort(pairs)
    return sparse(F.transform(ordered, lambda p: p["index"]), F.transform(ordered, lambda p: p["value"]), dim)


def singleton(index: int, value: float, dim: int) -> Column:
    return sparse(F.array(F.lit(index)), F.array(F.lit(value)), dim)


def valid(v: Column) -> Column:
    """Equal lengths, not empty, strictly ascending indices under dim, finite values."""
    ascending = F.forall(F.zip_with(F.slice(v["indices"], F.lit(1), F.size(v["indices"]) - 1), F.slice(v["indices"], F.lit(2), F.size(v["indices"])), lambda a, b: a < b), lambda ok: ok)
    inside = F.forall(v["indices"], lambda i: (i >= 0) & (i < v["dim"]))
    finite = F.forall(v["values"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sized = (F.size(v["indices"]) == F.size(v["values"])) & (F.size(v["indices"]) > 0)
    return F.coalesce(F.when(sized, ascending & inside & finite).otherwise(F.lit(False)), F.lit(False))


def nnz(v: Column) -> Column:
    return F.size(v["indices"])


def pairs(v: Column) -> Column:
    return F.arrays_zip(v["indices"], v["values"])


def get(v: Column, index: Column | int) -> Column:
    """The value at an index; 0 where there is none."""
    return F.coalesce(F.try_element_at(F.map_from_arrays(v["indices"], v["values"]), F.lit(index).cast("bigint") if isinstance(index, int) else index), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    other = F.map_from_arrays(b["indices"], b["values"])
    products = F.zip_with(a["indices"], a["values"], lambda i, x: x * F.coalesce(F.try_element_at(other, i), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalized(v: Column) -> Column:
    """NULL for a vector of norm zero, which has no direction."""
    return F.when(norm(v) > 0, sparse(v["indices"], F.transform(v["values"], lambda x: x / norm(v)), v["dim"]))


def to_postings(vectors: DataFrame, column: str = "sparse", id_column: str = "id") -> DataFrame:
    return vectors.select(F.col(id_column).alias("id"), F.explode(pairs(F.col(column))).alias("p")).select("id", F.col("p.indices").alias("term"), F.col("p.values").alias("weight"))


def from_postings(postings: DataFrame, dim: int) -> DataFrame:
    """(id, sparse); an id's terms are gathered, as many as it has."""
    gathered = postings.groupBy("id").agg(F.collect_list(F.struct(F.col("term").alias("index"), F.col("weight").alias("value"))).alias("p"))
    return gathered.select("id", from_pairs(F.col("p"), dim).alias("sparse"))
