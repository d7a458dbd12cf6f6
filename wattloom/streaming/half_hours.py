"""Streaming extension: irregular events to half-hour readings, with the same aggregates on batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample(events: DataFrame, late: str = "1 hour", ts: str = "ts", keys: tuple[str, ...] = ("household_id", "fuel"), value: str = "value") -> DataFrame:
    """Sum and count in tumbling half-hours; on a stream, rows later than `late` are dropped by the watermark."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", "30 minutes").alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "total", "n")


def running_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """Token counts as a stream's complete-mode aggregate; state is bounded by the vocabulary."""
    return tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True):
    """Writes a stream as Parquet (append) with its checkpoint in a shared folder."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
