"""Windowed counts and sessions of events: the same transformations on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def with_time(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """events with ts as a timestamp, which watermarks ask for; with `lateness`, later rows are dropped from a stream's state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed if lateness is None else timed.withWatermark("ts", lateness)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def per_window(events: DataFrame, size: str = "1 day", keys: tuple = ("event_type",), slide: str | None = None, users: bool = False) -> DataFrame:
    """(start, keys, n) per tumbling (or, with slide, hopping) window; users adds how many there are, on a table alone."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = [F.count("*").alias("n")] + ([F.count_distinct("user_id").alias("n_users")] if users else [])
    return events.groupBy(window.alias("w"), *keys).agg(*counts).select(F.col("w.start").alias("start"), *keys, "n", *(["n_users"] if users else []))


def sessions(events: DataFrame, gap: str = "2 hours", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): events of a key with less than `gap` between neighbours."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append what windows have closed to a Parquet table; with available_now, end when all files that are there are read."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
