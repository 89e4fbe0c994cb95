"""Running metrics over event time, the same expression for batch and streams (ST6, A29, A30)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total); with ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    agg = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_events(spark, path: str) -> DataFrame:
    """The event files of a folder as a stream, with event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
