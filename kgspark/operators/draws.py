"""Draws with replacement: exactly as many as asked, in proportion to the rows, without an order over all rows.

n rows are dealt to small buckets by a seeded hash. The draws start at the
root of a tree over the buckets and go down by binomial numbers: of d draws at a
node, its first child gets Binomial(d, its rows / the node's rows), the next one
Binomial of what is left, and so on: together a multinomial number, seeded by
the node. In a bucket each draw then picks one of its rows by a seeded hash. So
the rows' counts are those of a multinomial draw over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import written

#: Rows and draws of a bucket, about; children of a node; draws made from one row of a table at a time.
BUCKET_ROWS = 2048
BUCKET_DRAWS = 1 << 15
FAN = 64
BLOCK = 10_000


def _down(counts: DataFrame, roots: DataFrame, levels: int, seed: int) -> DataFrame:
    """(tree, bucket, rows, draws) of counts(tree, bucket, rows) and roots(tree, draws): the draws split down the trees, FAN children a node."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        words = [seed, int(pdf["tree"][0]), int(pdf["level"][0]), int(pdf["node"][0]) // FAN]
        rng = np.random.default_rng([w & 0xFFFFFFFFFFFFFFFF for w in words])
        left, rows, got = int(pdf["draws"][0]), int(pdf["rows"].sum()), []
        for n in pdf["rows"]:
            got.append(left if n == rows else int(rng.binomial(left, n / rows)))
            left, rows = left - got[-1], rows - int(n)
        return pdf.assign(draws=got)

    above = roots.select("tree", F.lit(0).cast("long").alias("parent"), "draws")
    for level in range(levels):
        width = FAN ** (levels - 1 - level)
        nodes = counts.groupBy("tree", F.floor(F.col("bucket") / width).alias("node")).agg(F.sum("rows").alias("rows"))
        met = nodes.withColumn("parent", F.floor(F.col("node") / FAN)).join(above, ["tree", "parent"])
        got = met.select("tree", "parent", "node", "rows", "draws", F.lit(level).alias("level")).groupBy("tree", "parent").applyInPandas(split, "tree long, parent long, node long, rows long, draws long, level int")
        above = got.select("tree", F.col("node").alias("parent"), "draws").where("draws > 0")
    return above.select("tree", F.col("parent").alias("bucket"), "draws").join(counts, ["tree", "bucket"])


def _times(n: F.Column) -> F.Column:
    """0-based blocks of n things, as an array of (from, to)."""
    last = F.floor((n - 1) / BLOCK)
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct((k * BLOCK + 1).alias("low"), F.least((k + 1) * BLOCK, n).alias("high")))


def repeated_rows(rows: DataFrame, times: str, name: str) -> DataFrame:
    """rows, each `times` times, numbered from 1 in the column name; rows with fewer than one are left out."""
    own = [c for c in rows.columns if c != times]
    blocks = rows.where(F.col(times) > 0).withColumn("_block", F.explode(_times(F.col(times))))
    return blocks.select(*own, F.explode(F.sequence("_block.low", "_block.high")).alias(name))


def drawn_by(rows: DataFrame, group: F.Column, key: str | list[str], draws: F.Column, seed: int = 34) -> DataFrame:
    """rows as often as their group's seeded draws with replacement hit them, numbered in the column draw.

    draws is a Column of a group's number of rows, `n`; each group gets exactly
    that many rows. The same table read the same way gives the same draws; rows
    of equal key, repeated ones too, are drawn each for itself. Null groups and
    keys are drawn like others; groups whose draws are null or below 1 have none.
    """
    key = [key] if isinstance(key, str) else key
    # The serial number keeps a hot key's rows apart; written, so that every reader sees the same places.
    spread = rows.withColumns({"_tree": F.xxhash64(group), "_serial": F.monotonically_increasing_id()})
    spread = written(spread, "draws-rows")
    roots = spread.groupBy(F.col("_tree").alias("tree")).agg(F.count("*").alias("n")).withColumn("draws", draws.cast("long")).where("draws > 0")
    roots = written(roots.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS), F.ceil(F.col("draws") / BUCKET_DRAWS)).cast("long")), "draws-trees")
    most = roots.agg(F.max("buckets")).first()[0]
    if most is None:
        return rows.withColumn("draw", F.lit(1).cast("long")).where("false")
    levels = next(k for k in range(1, 20) if FAN**k >= most)
    place = F.pmod(F.xxhash64(F.lit(seed), *key, "_serial"), F.col("buckets"))
    placed = written(spread.join(roots.select("tree", "buckets"), F.col("_tree") == F.col("tree")).withColumn("_bucket", place).drop("tree", "buckets"), "draws-placed")
    counts = written(placed.groupBy(F.col("_tree").alias("tree"), F.col("_bucket").alias("bucket")).agg(F.count("*").alias("rows")), "draws-buckets")
    given = written(_down(counts, roots, levels, seed), "draws-split")
    picks = repeated_rows(given.withColumnRenamed("draws", "_n"), "_n", "_draw")
    at = F.floor(F.pmod(F.xxhash64(F.lit(seed + 1), "tree", "bucket", "_draw"), F.lit(1 << 52)) / float(1 << 52) * F.col("rows")) + 1
    picks = picks.select("tree", "bucket", at.alias("_at")).groupBy("tree", "bucket", "_at").agg(F.count("*").alias("_times"))
    nth = F.row_number().over(W.partitionBy("_tree", "_bucket").orderBy(F.xxhash64(F.lit(seed + 2), *key, "_serial"), "_serial"))  # a bucket's rows
    same = (F.col("_tree") == F.col("tree")) & (F.col("_bucket") == F.col("bucket")) & (F.col("_nth") == F.col("_at"))
    met = placed.withColumn("_nth", nth).join(picks, same)
    return repeated_rows(met.select(*rows.columns, "_times"), "_times", "draw")


def drawn(rows: DataFrame, key: str, draws: int, seed: int = 34) -> DataFrame:
    """rows as often as `draws` draws with replacement hit them, numbered in the column draw; exactly `draws` rows in all, if there are rows at all."""
    return drawn_by(rows, F.lit(0), key, F.lit(draws), seed)
