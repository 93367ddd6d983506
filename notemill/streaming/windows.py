"""An extension: windowed counts over an event stream. Each works on a batch as on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counts(events: DataFrame, ts: str, width: str, slide: str | None = None, by: str = "event_type", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Events and their values by window and type; on a stream, windows close `late` after their end."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark(ts, late) if events.isStreaming else stamped
    windowed = stamped.groupBy(F.window(ts, width, slide or width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return windowed.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of one key with gaps below `gap`."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark(ts, late) if events.isStreaming else stamped
    windowed = stamped.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")
