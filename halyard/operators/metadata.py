"""Per-id metadata: validation, and the store's operations over rows
(id, key, value) with a VARIANT value, or over typed columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of metadata.
MAX_KEYS, MAX_KEY_BYTES, MAX_STRING_BYTES, MAX_ELEMENTS = 64, 256, 65_536, 1_024


class MetadataError(ValueError):
    pass


def check_key(key: str) -> None:
    if not 1 <= len(key.encode()) <= MAX_KEY_BYTES or not re.fullmatch(r"[A-Za-z0-9_]+", key):
        raise MetadataError(f"not a metadata key: {key!r}")


def check_value(value: Any) -> None:
    """A string, a 64-bit whole number, a finite double, a boolean or a list of
    strings."""
    if isinstance(value, str):
        if len(value.encode()) > MAX_STRING_BYTES:
            raise MetadataError("a string is too long")
    elif isinstance(value, bool):
        pass
    elif isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise MetadataError("a whole number does not fit 64 bits")
    elif isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise MetadataError("a number must be finite")
    elif isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        if len(value) > MAX_ELEMENTS:
            raise MetadataError("a list is too long")
        for x in value:
            check_value(x)
    else:
        raise MetadataError(f"{type(value).__name__} is not a metadata value")


def check(metadata: dict[str, Any]) -> None:
    if len(metadata) > MAX_KEYS:
        raise MetadataError(f"over {MAX_KEYS} keys")
    for k, v in metadata.items():
        check_key(k)
        check_value(v)


def valid_key(key: Column) -> Column:
    return key.rlike("^[A-Za-z0-9_]{1,256}$")


def from_json(rows: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """(id, key, value) of the top-level members of JSON objects; nulls do
    not exist, nested values are not metadata."""
    objects = F.from_json(F.col(column), "map<string,string>")
    parsed = rows.select(F.col(id_column).alias("id"), F.explode(objects).alias("key", "raw"), F.try_parse_json(F.col(column)).alias("all_"))
    value = F.try_variant_get("all_", F.concat(F.lit("$."), F.col("key")), "variant")
    found = parsed.where(valid_key(F.col("key"))).withColumn("value", value)
    kind = F.schema_of_variant("value")
    return found.where(~kind.startswith("OBJECT") & (kind != "VOID") & (~kind.startswith("ARRAY") | (kind == "ARRAY<STRING>"))).select("id", "key", "value")


def merge(own: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("id", "key")) -> DataFrame:
    """All rows of both; on the same key the other's stands."""
    return own.join(other.select(*keys), list(keys), "left_anti").unionByName(other)


def upsert(own: DataFrame, changes: DataFrame) -> DataFrame:
    return merge(own, changes)


def update(own: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of keys that exist; others have no effect."""
    return merge(own, changes.join(own.select("id", "key"), ["id", "key"], "left_semi"))


def delete(own: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given (id, key) rows, or without the given ids."""
    return own.join(gone, [c for c in ("id", "key") if c in gone.columns], "left_anti")


def key_counts(own: DataFrame) -> DataFrame:
    return own.groupBy("id").agg(F.count("*").alias("keys"))


def totals(own: DataFrame) -> DataFrame:
    """Ids with metadata and keys in all."""
    return own.agg(F.countDistinct("id").alias("vectors"), F.count("*").alias("keys"))
