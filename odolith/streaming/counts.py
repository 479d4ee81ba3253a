"""Counts from a stream of passages: tumbling windows with a watermark, as input to the comparison with modeled flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, *, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, *, at: str = "ts", by: str = "event_type", value: str = "value", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(window_start, by, n, total)`` per tumbling window; events later than the watermark are dropped by a stream, and only by it."""
    if events.isStreaming and dict(events.dtypes)[at] == "timestamp_ntz":  # a watermark needs a point in time: of the session's zone
        events = events.withColumn(at, F.col(at).cast("timestamp"))
    marked = events.withWatermark(at, late) if events.isStreaming else events
    per = marked.groupBy(F.window(at, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return per.select(F.col("w.start").alias("window_start"), by, "n", "total")


def write(counts: DataFrame, folder: str, checkpoint: str):
    """Append closed windows to parquet, exactly once, until what is there is processed."""
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
