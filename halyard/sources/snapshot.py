"""Collections at rest: Parquet rows and a manifest row beside them.

The manifest holds what the rows do not: version, metric, dimensions, column
names, and counts that a load is checked against. It is written last, so a
folder with a manifest is whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.collection import Collection

VERSION = 1
_MANIFEST = "version int, metric string, dimensions int, id_column string, vector_column string, compact_over double, rows long, checksum long, part string"


class SnapshotError(ValueError):
    pass


def checksum(rows: DataFrame, id_column: str, vector_column: str) -> tuple[int, int]:
    """Rows, and a sum over the hashes of ids and vectors, in any order."""
    found = rows.agg(F.count("*"), F.sum(F.pmod(F.xxhash64(id_column, vector_column), F.lit(1 << 31)))).first()
    return found[0], found[1] or 0


def save(collection: Collection, path: str) -> None:
    """Write a snapshot, replacing an older one only once the new is whole."""
    spark = collection.rows.sparkSession
    part = f"rows-{uuid.uuid4().hex}"
    collection.rows.write.parquet(f"{path}/{part}")
    n, total = checksum(spark.read.parquet(f"{path}/{part}"), collection.id_column, collection.vector_column)
    manifest = [(VERSION, collection.metric, collection.dimensions, collection.id_column, collection.vector_column, collection.compact_over, n, total, part)]
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, verify: bool = True) -> Collection:
    """Read a snapshot; verify compares its rows with the manifest's counts.
    A column that older snapshots lack reads as missing."""
    m = spark.read.parquet(f"{path}/manifest").first()
    if m["version"] > VERSION:
        raise SnapshotError(f"version {m['version']} is newer than {VERSION}")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{m['part']}")
    if verify and checksum(rows, m["id_column"], m["vector_column"]) != (m["rows"], m["checksum"]):
        raise SnapshotError("the rows do not match the manifest")
    return Collection(rows, m["dimensions"], m["metric"], m["id_column"], m["vector_column"], m["compact_over"])
