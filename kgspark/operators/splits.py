"""Splits and sampling of labelled rows, without rand(): order comes from a hash or from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.components import components
from kgspark.operators.draws import drawn
from kgspark.operators.ordered import running_sums
from kgspark.session import written


def by_year_left_out(start: Column, complete: Column, year: int, mode: str = "one-start") -> Column:
    """Finished rows outside the year(s) train, inside validate; unfinished ones test. one-start, since-start or one-end."""
    inside = {"one-start": (start >= year) & (start < year + 1), "since-start": start >= year, "one-end": (complete >= year) & (complete < year + 1)}[mode]
    finished = (complete > 0) & (complete < 2020.5)
    return F.when(finished & ~inside, "train").when(finished & inside, "val").otherwise("test")


def by_threshold(year: Column, train_to: float, val_to: float) -> Column:
    return F.when((year > 0) & (year <= train_to), "train").when((year > 0) & (year <= val_to), "val").otherwise("test")


def positional_cuts(rows: DataFrame, value: str, fractions: tuple = (0.7, 0.85)) -> DataFrame:
    """One row: cut_0, cut_1, ..: the value at 0-based place int(n * fraction) of the sorted values.

    Counts per value are summed by ranges of the values, so no task holds all of them.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, ["v"], {"_before": F.col("n")}, "cuts").withColumn("upto", F.col("_before") + F.col("n"))
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("n").alias("all"))))  # one row
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("all") * f), F.col("v"))).alias(f"cut_{k}") for k, f in enumerate(fractions)])


def temporal_end(rows: DataFrame, year: str, merge_validation: bool = False) -> DataFrame:
    """rows with split by the 70 % and 85 % places of the sorted years; merge_validation puts val into train."""
    cut = rows.crossJoin(F.broadcast(positional_cuts(rows, year)))  # one row
    y = F.col(year)
    early = F.when((y >= 0) & (y <= F.col("cut_0")), "train").when((y >= 0) & (y <= F.col("cut_1")), "train" if merge_validation else "val")
    return cut.withColumn("split", early.otherwise("test")).drop("cut_0", "cut_1")


def quota(groups: DataFrame, size: str, order: list, fractions: tuple = (0.7, 0.15), total: int | None = None) -> DataFrame:
    """groups with split: walked in order, each goes to train while train's rows are below int(0.7 n), then val likewise, then test.

    A group may overshoot its quota, as a greedy fill does. Running sums are
    taken by ranges of the order, so no task holds all groups.
    """
    walked = running_sums(groups, order, {"_before": F.col(size)}, "quota")
    n = walked.agg(F.lit(total).alias("_n") if total is not None else F.sum(size).alias("_n"))
    ranked = walked.crossJoin(F.broadcast(n)).withColumn("_train", F.col("_before") < F.floor(F.col("_n") * fractions[0]))  # one row
    trained = ranked.agg(F.coalesce(F.sum(F.when(F.col("_train"), F.col(size))), F.lit(0)).alias("_trained"))
    ranked = ranked.crossJoin(F.broadcast(trained))  # one row
    val = ~F.col("_train") & (F.col("_before") - F.col("_trained") < F.floor(F.col("_n") * fractions[1]))
    return ranked.withColumn("split", F.when(F.col("_train"), "train").when(val, "val").otherwise("test")).drop("_n", "_before", "_train", "_trained")


def hash_order(*columns: str, seed: int = 34) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def random_split(rows: DataFrame, key: str, seed: int = 34) -> DataFrame:
    """70 / 15 / 15 by a seeded hash of the key: no order over all rows is needed."""
    part = F.pmod(hash_order(key, seed=seed), F.lit(10_000))
    return rows.withColumn("split", F.when(part < 7000, "train").when(part < 8500, "val").otherwise("test"))


def component_split(rows: DataFrame, left: str, right: str, seed: int = 34, order: list | None = None) -> DataFrame:
    """rows with split such that no value of left or right straddles it: components of the bipartite graph, filled by quota.

    Components are walked in a seeded order of their least nodes (`l:` and the
    least left value), or in the order given. Only the lefts that share a right
    become edges, each to the least of them; a left alone is a component.
    """
    tag = lambda c: F.concat(F.lit("l:"), F.col(c).cast("string"))
    both = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("_l"), F.col(right).alias("_r"))
    shared = both.groupBy("_r").agg(F.min("_l").alias("_m"), F.max("_l").alias("_x"), F.count("*").alias("_n")).where("_m <> _x")
    shared = written(shared, "shared")
    between = both.join(shared.where("_n > 2").select("_r", "_m", "_x"), "_r").where("_l <> _m and _l <> _x").select("_m", F.col("_l").alias("_x"))
    found = components(shared.select("_m", "_x").unionByName(between), "_m", "_x")
    named = found.join(found.groupBy("component").agg(F.min(tag("node")).alias("_name")), "component").select("node", "_name")
    lefts = rows.where(F.col(left).isNotNull()).groupBy(F.col(left).alias("_l")).agg(F.count("*").alias("n"), F.count(right).alias("_linked")).where("_linked > 0")
    lefts = written(lefts.join(named, F.col("_l") == F.col("node"), "left").select("_l", "n", F.coalesce("_name", tag("_l")).alias("component")), "lefts")
    sizes = lefts.groupBy("component").agg(F.sum("n").alias("n"))
    parts = quota(sizes, "n", order or [hash_order("component", seed=seed), "component"])
    of = lefts.join(parts.select("component", "split"), "component").select("_l", "split")
    return rows.join(of, F.col(left) == F.col("_l")).drop("_l")


def by_group(rows: DataFrame, group: str, order: list, fractions: tuple = (0.7, 0.15), subsample: int = 0) -> DataFrame:
    """rows with the split of their group, groups filled by quota in the order given.

    With subsample, training groups that bring the training rows to that number
    or above it, walked in the same order, take part in no split: `none`.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    parts = quota(sizes, "_size", order, fractions)
    if subsample > 0:
        train = running_sums(parts.where("split = 'train'"), order, {"_upto": F.col("_size")}, "subsample")
        kept = F.when(F.col("_upto") + F.col("_size") < subsample, "train").otherwise("none")
        parts = train.withColumn("split", kept).drop("_upto").unionByName(parts.where("split <> 'train'"))
    return rows.join(parts.select(F.col(group).alias("_group"), "split"), F.col(group) == F.col("_group")).drop("_group")


def by_lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, split: str = "split") -> DataFrame:
    """rows with the split that a table names for their key; null where it names none."""
    known = table.select(F.col(table_key).alias("_key"), F.col(split).alias("_split"))
    return rows.join(known, F.col(key) == F.col("_key"), "left").withColumn("split", F.col("_split")).drop("_key", "_split")


def train_on_validation(split: Column) -> Column:
    """Training rows left out, validation rows trained on: for a final run."""
    return F.when(split == "val", "train").when(split == "test", "test")


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def by_list(values: Column, listed: list) -> Column:
    """test if any of the values is listed, else train."""
    return F.when(F.arrays_overlap(values, F.array(*map(F.lit, listed))), "test").otherwise("train")


def by_arms(n_arms: Column, key: Column, seed: int = 34, exact: bool = False) -> Column:
    """Single-arm trials train; of the others a quarter trains (none if exact), the rest is halved."""
    part = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000))
    train = 0 if exact else 250
    return F.when((n_arms == 1) | (part < train), "train").when(part < train + (1000 - train) // 2, "val").otherwise("test")


def violations(rows: DataFrame, key: str) -> DataFrame:
    """(check, n): rows without a split, and keys in more than one."""
    null = rows.agg(F.count_if(F.col("split").isNull()).alias("n")).select(F.lit("null split").alias("check"), "n")
    straddling = rows.groupBy(key).agg((F.min("split") != F.max("split")).alias("s")).agg(F.count_if("s").alias("n"))
    return null.union(straddling.select(F.lit("straddling key").alias("check"), "n"))


def repeated(rows: DataFrame, least: int) -> DataFrame:
    """rows, as often as it takes for at least `least` of them."""
    n = rows.count()
    times = max(1, -(-least // n)) if n else 1
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def balanced(rows: DataFrame, label: str, key: str, ratio: int = 10, seed: int = 34, replace: bool = False) -> DataFrame:
    """All positives, and negatives by hash up to about ratio times as many; with `replace`, drawn with replacement."""
    if replace:
        positives = rows.where(F.col(label) == 1)
        return positives.withColumn("draw", F.lit(1).cast("long")).unionByName(drawn(rows.where(F.col(label) == 0), key, ratio * positives.count(), seed))
    counts = rows.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    part = F.pmod(hash_order(key, seed=seed), F.lit(1_000_000)) / 1e6
    joined = rows.crossJoin(F.broadcast(counts))  # one row
    return joined.where((F.col(label) == 1) | (part < ratio * F.col("p") / F.greatest(F.col("n"), F.lit(1)))).drop("p", "n")
