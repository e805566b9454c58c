"""Structured Streaming over event tables. An extension: the batch engine does not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total of tumbling windows; works on batch and streaming input alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_to_table(spark: SparkSession, folder: str, schema: str | StructType, checkpoint: str, name: str) -> DataFrame:
    """All files under folder through the windows into an in-memory table, until nothing is left."""
    events = spark.readStream.schema(schema).parquet(folder)
    query = windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
