"""Running sums in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import written


def running_sums(rows: DataFrame, order: list, sums: dict[str, Column], name: str = "running-sums") -> DataFrame:
    """rows with, per name in sums, the sum of its Column over all rows that stand before in `order` (0 for the first).

    Rows are range-partitioned by the order and summed within each range; the
    ranges' totals, one row a partition, are summed in one task and broadcast.
    The order should be total, else equal rows take any order among themselves.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.withColumns({f"_{k}_own": c for k, c in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()), name)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(f"_{k}_own").alias(f"_{k}_all") for k in sums])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{k}_all").over(before), F.lit(0)).alias(f"_{k}_off") for k in sums])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.withColumns({f"_{k}_in": F.coalesce(F.sum(f"_{k}_own").over(within), F.lit(0)) for k in sums}).join(F.broadcast(parts), "_part")  # one row a partition
    return out.select(*rows.columns, *[(F.col(f"_{k}_in") + F.col(f"_{k}_off")).alias(k) for k in sums])
