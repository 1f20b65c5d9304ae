"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on doc_id.

Documents are range-partitioned and sorted by doc_id, tokenized in place and
written one ORC file a partition. ORC itself run-length encodes the ids, keeps
min/max statistics a stripe and a row group, and, as asked, a Bloom filter on
doc_id in each row group, so that a look-up of some ids reads the few groups
that can hold them. Stripes are independent: Spark reads them in parallel.

Null texts are empty ones (the end id alone); null doc_ids sort first;
repeated rows stay, in order of (doc_id, n_tokens, crc). Other columns are
ignored. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import shared_folder

SCHEMA = "doc_id long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document, in the order of the input's partitions."""

    def encode(batches):
        from kgspark.llm.tokens import encoder

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = encoder(tokenizer).encode(batch.column("text").to_pylist())
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the documents' ids in ascending doc_id order, across and within files."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    tokenized(ordered, tokenizer).write.format("orc").options(**OPTIONS).save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids; with doc_ids, stripes and row groups that can't hold them are skipped."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file's offset comes from the files' totals, read from the two narrow
    columns alone; the running sum is then within one file.
    """

    def crc(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, ends = np.asarray(ids.flatten(), "<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], names=["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"))
    before = W.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    within = W.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    docs = rows.select("file", "doc_id", "ids").mapInArrow(crc, "file string, doc_id long, n_tokens long, ids_crc32 long")
    docs = docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return docs.join(files, "file").select("doc_id", (F.col("file_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, read back and digest."""
    path = shared_folder(docs.sparkSession, "orc-tokens")
    write_tokens(docs, path, tokenizer)
    return digest(docs.sparkSession, path)
