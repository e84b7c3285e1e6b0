"""Event-time windows over a stream of events, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.sources import storage


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n, total: works on a stream (append mode emits a window when the watermark passes it) and on a table."""
    t = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark(time, late)
    g = t.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), kind, "n", "total")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there and stop; restarted, it goes on where it was."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of the events table read as a stream: what came out when the watermark had passed them."""
    at = storage.scratch(spark, "stream")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    run_to_parquet(windowed_counts(src), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")
