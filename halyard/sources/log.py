"""A log of changes: numbered entries with a checksum each.

Entries are (seq, op, id, embedding, crc) with op `insert` or `delete`. Replay
takes entries in the order of seq up to the first that is torn: a gap in the
numbers or a checksum that does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA = "seq long, op string, id long, embedding array<float>, crc long"


def entry_crc() -> Column:
    return F.crc32(F.concat_ws("|", F.col("seq"), "op", F.col("id"), F.to_json("embedding")).cast("binary"))


def append(entries: DataFrame, path: str) -> None:
    """Add entries (seq, op, id, embedding); seq continues the log."""
    entries.withColumn("crc", entry_crc()).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def whole_prefix(log: DataFrame) -> DataFrame:
    """The entries before the first torn one. Two numbers reach the driver:
    the least seq, and the first that is missing or torn."""
    good = log.where(F.col("crc") == entry_crc()).select("seq").distinct()
    start = log.agg(F.min("seq")).first()[0]
    if start is None:
        return log.drop("crc")
    # An entry is followed if its successor is there: an equi-join, not a scan in one task.
    followed = good.select((F.col("seq") - 1).alias("seq"))
    end = good.join(followed, "seq", "left_anti").agg(F.min("seq")).first()[0]
    if good.where(F.col("seq") == start).isEmpty():
        return log.limit(0).drop("crc")
    return log.where((F.col("seq") <= end) & (F.col("crc") == entry_crc())).drop("crc")


def state(log: DataFrame) -> DataFrame:
    """The live rows after a log: the last entry of each id, if an insert."""
    last = W.partitionBy("id").orderBy(F.col("seq").desc())
    return log.withColumn("n_", F.row_number().over(last)).where("n_ = 1 AND op = 'insert'").select("id", "embedding", "seq")


def replay(spark: SparkSession, path: str) -> DataFrame:
    return state(whole_prefix(read(spark, path)))
