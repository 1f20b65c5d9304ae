"""Packing of token ids into sequences: first-fit decreasing on a tournament tree.

Documents are tokenized where they are read and cut into pieces of at most
`length` ids; only the pieces' descriptions move. A seeded hash deals the
documents to random groups of about `group_rows`, and each group is packed on
its own: its pieces, longest first, go to the first bin with room, found in a
tournament tree over the bins' capacities. A group leaves about one bin
part-filled, so the loss is bounded by 1 / (bins in a group).

Null and empty texts give one piece, the end id; a very long text gives many
pieces, all but its last one filling a bin. Repeated rows are packed once
each, and dealt apart by their number and their partition, so that a row
repeated without end is no single group. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 4096
GROUP_ROWS = 4096
#: Words in a generation of a worker's memo: fewer than token files take, as packing stands behind other stages in a pipeline.
MEMO_WORDS = 350_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32", "nth"]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, items taken longest first (ties: as given), each into the first bin with room.

    tree[1] holds the most room in any bin; a leaf holds one bin's room. The
    tree is made for as many bins as items, so every item finds one.
    """
    n = len(lengths)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        where[item], offset[item] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node >>= 1
            room = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == room:
                break
            tree[node] = room
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens; doc_crc32 of all its ids, and nth of the equal documents of its partition."""

    def cut(batches):
        from kgspark.llm.tokens import encoder

        met: dict[tuple, int] = {}
        for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, 512)):
            batch, rows = whole.slice(at, 512), []
            encoded = encoder(tokenizer, MEMO_WORDS).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                total, key = len(ids) // 4, (doc_id, zlib.crc32(ids))
                nth = met[key] = met.get(key, -1) + 1
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, key[1], nth))
            columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", doc_crc32 long, nth long")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_rows: int = GROUP_ROWS, seed: int = 17) -> DataFrame:
    """One row per piece with its sequence_id and its offset there; offsets of a sequence have no gaps."""
    groups = max(1, -(-docs.count() // group_rows))
    apart = F.when(F.col("doc_id").isNull() | (F.col("nth") > 0), F.struct("nth", F.spark_partition_id()))
    dealt = pieces(docs, tokenizer, length).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_crc32", apart), F.lit(groups))).drop("doc_crc32", "nth")

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        where, offset = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    return dealt.groupBy("g").applyInPandas(fill, PACKED)
