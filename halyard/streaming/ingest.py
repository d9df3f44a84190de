"""Inserts and deletes from a stream.

Changes are (id, op, ts, embedding). A micro-batch goes to a log of Parquet
files under its batch number, so a batch that is run again after a failure
replaces itself; the state is the last change of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(changes: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Without repeats of an (id, op) within the watermark; state that is
    older is dropped."""
    return changes.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id", "op"])


def follow(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of changes as a log."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changes_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def current(log: DataFrame) -> DataFrame:
    """The live rows: the last change of each id by time, a delete before an
    insert of the same time. One aggregate, combined before its shuffle."""
    columns = [c for c in log.columns if c not in ("id", "op", "ts", "batch")]
    last = log.groupBy("id").agg(F.max(F.struct("ts", "op", *columns)).alias("last"))
    return last.where("last.op = 'insert'").select("id", "last.ts", *[f"last.{c}" for c in columns])


def windowed_counts(changes: DataFrame, every: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Inserts and deletes by time window, for a stream or a table."""
    rows = changes.withWatermark("ts", lateness) if changes.isStreaming else changes
    return rows.groupBy(F.window("ts", every)).agg(F.count_if(F.col("op") == "insert").alias("inserts"), F.count_if(F.col("op") == "delete").alias("deletes"))
