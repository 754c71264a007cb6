"""Streaming twins: rule counts over event time, and re-verification of citations as snapshots arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators import snapshots


def rule_counts(events: DataFrame, time: str = "scanned_at", key: str = "rule_id", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, key, n) over tumbling windows of event time; rows later than the watermark are dropped on a stream. Works on a batch alike."""
    rows = events.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n): runs of a key's rows with no pause longer than `gap`."""
    rows = events.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.col(key).alias("key"), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def follow_snapshots(stream: DataFrame, folder: str, scope: list[str], key: list[str], values: list[str]):
    """A stream writer that compares every micro-batch (one delivery) with the stored index and swaps the index.

    Writes folder/index-N, the index with the kind of change of each entry, and folder/changes/batch=N. A batch that runs again
    after a failure reads the index of the batch before it and overwrites its own output, so each delivery counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = snapshots.entries(spark.read.parquet(f"{folder}/index-{number - 1}")) if number else None
        snapshots.probe(index, batch, scope, key, values).write.mode("overwrite").parquet(f"{folder}/index-{number}")
        snapshots.changed(spark.read.parquet(f"{folder}/index-{number}"), scope, key).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
