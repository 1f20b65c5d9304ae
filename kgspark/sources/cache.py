"""Caches of costly look-ups that survive a kill: batches of rows, and a manifest of those that count.

A batch's rows are written first, in a folder of its own; then one small file in
the manifest, made aside and renamed, says that the batch counts. What a killed
run leaves without such a file is never read, and written anew by the next
run, so no key is lost and none counts twice. Later batches' rows of a key
replace earlier ones (an upsert).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Cache:
    """rows of (key, .. as in schema) below path, which all machines share.

    schema: the columns that a look-up gives for a key, as DDL. A key without a
    result has one row of nulls, and is done. Null keys are no keys.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, key_type: str = "string"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"`{key}` {key_type}, {schema}"
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    def manifest(self) -> list[dict]:
        """The committed batches, oldest first: batch, seq, keys."""
        out = []
        for status in self._fs.listStatus(self._path(f"{self.path}/manifest")):
            if status.getPath().getName().endswith(".json"):
                stream = self._fs.open(status.getPath())
                try:
                    out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return sorted(out, key=lambda b: (b["seq"], b["batch"]))

    def _commit(self, batch: str, seq: int, keys: int) -> None:
        aside, final = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/{batch}.json")
        stream = self._fs.create(aside)
        stream.write(json.dumps({"batch": batch, "seq": seq, "keys": keys}).encode())
        stream.close()
        if not self._fs.rename(aside, final):
            raise RuntimeError(f"batch {batch} was committed by another run")

    def write(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Commit rows (key and the schema's columns) as one batch, newer than all so far; a batch that is committed already is left as it is."""
        known = self.manifest()
        batch = batch or uuid.uuid4().hex
        if any(b["batch"] == batch for b in known):
            return False
        seq = 1 + max((b["seq"] for b in known), default=0)
        own = rows.where(F.col(self.key).isNotNull()).select(*self._columns())
        folder = f"{self.path}/rows/{batch}"
        own.write.mode("overwrite").parquet(folder)  # a killed run may have left a part of it
        keys = self.spark.read.schema(self.schema).parquet(folder).select(self.key).distinct().count()
        self._commit(batch, seq, keys)
        return True

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def read(self) -> DataFrame:
        """The rows that count: of each key those of its newest batch."""
        batches = self.manifest()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/rows/{b['batch']}" for b in batches]
        order = self.spark.createDataFrame([(b["batch"], b["seq"]) for b in batches], "_batch string, _seq long")  # a line a batch
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        rows = rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), r"/rows/([^/]+)/[^/]+$", 1)).join(order, "_batch")
        newest = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max("_seq").alias("_newest"))
        return rows.join(newest, (F.col(self.key) == F.col("_key")) & (F.col("_seq") == F.col("_newest"))).select(*self._columns())

    def open_keys(self, wanted: DataFrame) -> DataFrame:
        """The different keys of wanted that no committed batch has."""
        keys = wanted.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        return keys.join(self.read().select(self.key).distinct(), self.key, "left_anti")

    def run(self, wanted: DataFrame, look_up: Callable[[DataFrame], DataFrame], size: int = 10_000) -> int:
        """Look up all open keys of wanted, in committed batches of about `size`; returns how many keys that were.

        look_up takes and returns a DataFrame with the key; it is asked for each open key once.
        """
        todo = self.open_keys(wanted)
        held = f"{self.path}/open/{uuid.uuid4().hex}"
        todo.write.parquet(held)  # a batch's commit must not move the keys of the next
        todo = self.spark.read.schema(todo.schema).parquet(held)
        n = todo.count()
        batches = -(-n // size)
        for k in range(batches):
            keys = todo.where(F.pmod(F.xxhash64(self.key), F.lit(batches)) == k)
            found = look_up(keys).select(*self._columns())
            self.write(keys.join(found, self.key, "left"))
        self._fs.delete(self._path(held), True)
        return n

    def from_stream(self, rows: DataFrame, epoch: int) -> None:
        """For foreachBatch: a micro-batch is committed once, however often the stream replays it."""
        self.write(rows, f"epoch-{epoch:020d}")
