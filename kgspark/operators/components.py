"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with a < b.

    Large star hangs every larger neighbour of u under the least of u's
    neighbourhood; small star does so for the smaller ones and u itself.
    """
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    pairs = down.unionAll(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else down
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    moved = joined.where("v > u" if large else "v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        moved = moved.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its least node.

    Nulls and self-loops are no edges (a self-loop alone yields no row). Each
    round is written to the shared folder; only one count and one checksum
    reach the driver. Raises if max_rounds don't suffice.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = written(e.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct(), "components")
    before = None
    for _ in range(max_rounds):
        e = written(_star(_star(e, large=True), large=False), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
