"""Streaming of alerts, an extension: counts per tumbling window, for a stream or a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of Parquet files that land in folder."""
    return spark.readStream.schema(schema).parquet(folder)


def counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, kind, n of events; on a stream, rows later than late are left out and state is dropped behind it."""
    rows = events.select(F.col(time).cast("timestamp").alias("_t"), F.col(kind).alias("kind"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_t", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def start(stream: DataFrame, target: str, checkpoint: str):
    """Appends closed windows to Parquet files in target; what has arrived is read, then the query ends."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
