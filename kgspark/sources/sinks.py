"""Sinks: edges, batches, caches and reports, each written by many tasks and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_tsv(edges: DataFrame, path: str) -> None:
    """Tab-separated edges with a header, one file a task."""
    edges.write.options(sep="\t", header="true", quote="").mode("overwrite").csv(path)


def edge_lists_by(edges: DataFrame, by: str, path: str) -> None:
    """One folder of edge lists per value of `by`, slashes in values as underscores."""
    named = edges.withColumn(by, F.replace(F.col(by).cast("string"), F.lit("/"), F.lit("_")))
    named.write.partitionBy(by).options(sep="\t").mode("overwrite").csv(path)


def batches(rows: DataFrame, path: str, size: int = 1000) -> None:
    """JSON files of at most `size` rows."""
    rows.write.option("maxRecordsPerFile", size).mode("overwrite").json(path)


def id_batches(ids: DataFrame, column: str, path: str, size: int = 1000) -> None:
    """Text files of at most `size` ids, one a line."""
    ids.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", size).mode("overwrite").text(path)


def append_cache(rows: DataFrame, path: str) -> None:
    """Add a checkpoint to a cache table; the reader keeps each key's last row, so a repeated checkpoint does no harm."""
    rows.write.mode("append").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    """A result as JSON lines."""
    rows.write.mode("overwrite").json(path)


def dataset(rows: DataFrame, path: str) -> None:
    """A partial result as Parquet, which the whole folder is read back from."""
    rows.write.mode("overwrite").parquet(path)
