"""Labels of arms, as long tables: arm, ae (adverse event), and the frequencies or odds ratios of two kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "total"


def merged_frequency(serious: Column, other: Column, how: str) -> Column:
    """max: the larger; serious: the serious one; mix: the larger of five times the serious one and the other."""
    s, o = F.coalesce(serious, F.lit(0.0)), F.coalesce(other, F.lit(0.0))
    return {"max": F.greatest(s, o), "serious": s, "mix": F.greatest(5 * s, o)}[how]


def by_total(rows: DataFrame, value: str, threshold: float, total: str = TOTAL) -> DataFrame:
    """(arm, label): 1 if the value of the `total` event is above the threshold (a frequency or an odds ratio), else 0."""
    return rows.where(F.col("ae") == total).select("arm", (F.col(value) > threshold).cast("int").alias("label"))


def has_results(arms: DataFrame, flag: str = "has_results") -> DataFrame:
    return arms.select("arm", F.coalesce(F.col(flag), F.lit(False)).cast("int").alias("label"))


def supported(rows: DataFrame, label: str, least: int, missing: str | None = None) -> DataFrame:
    """rows of the events with at least `least` positive labels, missing ones taken off."""
    good = F.sum(F.col(label)) - (F.sum(F.col(missing).cast("int")) if missing else F.lit(0))
    enough = rows.groupBy("ae").agg(good.alias("_n")).where(F.col("_n") >= least).select("ae")
    return rows.join(enough, "ae", "left_semi")


def by_frequency(rows: DataFrame, how: str, threshold: float, least: int, total: str = TOTAL) -> DataFrame:
    """(arm, ae, label, freq) of rows(arm, ae, serious, other) in percent, but for the total event, of events with enough positives.

    With `mix` a label is positive above 1 % serious or 5 % other events; else
    above the threshold. freq is the merged frequency as a part of one.
    """
    freq = merged_frequency(F.col("serious"), F.col("other"), how)
    mixed = (F.coalesce("serious", F.lit(0.0)) > 1) | (F.coalesce("other", F.lit(0.0)) > 5)
    label = mixed if how == "mix" else freq > threshold
    labelled = rows.where(F.col("ae") != total).select("arm", "ae", label.cast("int").alias("label"), (freq / 100).alias("freq"))
    return supported(labelled, "label", least)


def regression(rows: DataFrame, how: str, total: str = TOTAL) -> DataFrame:
    """(arm, ae, freq): the merged frequency itself, of all events but the total."""
    return rows.where(F.col("ae") != total).select("arm", "ae", merged_frequency(F.col("serious"), F.col("other"), how).alias("freq"))


def by_odds_ratio(rows: DataFrame, threshold: float, least: int, total: str = TOTAL) -> DataFrame:
    """(arm, ae, label, missing): the larger of two odds ratios above the threshold; -1 is a missing ratio, which takes support off."""
    ratio = F.greatest("serious", "other")
    labelled = rows.where(F.col("ae") != total).select("arm", "ae", (ratio > threshold).cast("int").alias("label"), (ratio == -1).alias("missing"))
    return supported(labelled, "label", least, "missing")


def any_event(rows: DataFrame, events: str) -> DataFrame:
    """(arm, label): 1 if the arm's list of events isn't empty."""
    return rows.select("arm", (F.size(F.coalesce(events, F.array().cast("array<string>"))) > 0).cast("int").alias("label"))


def event_ids(rows: DataFrame, events: str, single: str | None = None) -> DataFrame:
    """(arm, ae_id): an arm's events by their ids in ascending order of name, one row each; of a single event alone if one is named."""
    from kgspark.operators.graph import with_ids

    each = with_ids(rows.select("arm", F.explode(F.array_distinct(events)).alias("ae")), "ae", id="ae_id")
    return (each if single is None else each.where(F.col("ae") == single)).select("arm", "ae_id")


def efficacy_pairs(pairs: DataFrame, arms: DataFrame) -> DataFrame:
    """(nct_id, arm1, arm2, label): pairs(nct_id, a, b, positive) and their mirror images, both arms known; 1 if the second is the positive one."""
    both = pairs.select("nct_id", F.col("a").alias("arm1"), F.col("b").alias("arm2"), "positive").unionByName(pairs.select("nct_id", F.col("b").alias("arm1"), F.col("a").alias("arm2"), "positive"))
    for end in ("arm1", "arm2"):
        both = both.join(arms.select(F.col("arm").alias(end)).distinct(), end, "left_semi")
    return both.select("nct_id", "arm1", "arm2", (F.col("arm2") == F.col("positive")).cast("int").alias("label"))


def unmirrored(pairs: DataFrame) -> DataFrame:
    """Training pairs (arm1, arm2, split) whose mirror image doesn't train: none, if a split is sound."""
    train = pairs.where("split = 'train'").select("arm1", "arm2")
    return train.join(train.select(F.col("arm2").alias("arm1"), F.col("arm1").alias("arm2")), ["arm1", "arm2"], "left_anti")


def composite(arms: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the id of their arm, keys that name several arms): the look-up by trial, drugs and diseases, which must be unique."""
    of = arms.select(*keys, "node_id")
    twice = of.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    same = of.withColumnsRenamed({k: f"_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(same, met, "left").drop(*[f"_{k}" for k in keys]), twice


def selected(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Predictions above a threshold."""
    return scores.where(F.col("p") > threshold)


# The types that have features; concepts of the vocabulary (the last) yield to any other.
TYPE_ORDER = ["DRUG", "DISEASE", "PROTEIN", "TRIAL_ARM", "PRIMARY_OUTCOME", "UMLS"]


def arm_vectors(arms: DataFrame, texts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(key, vector) of arms(key), named trial:arm: their trial's text vector and attribute vector, one behind the other; texts, attributes: trial, vector.

    Arms of a trial that lacks either have none.
    """
    of = arms.select("key", F.substring_index("key", ":", 1).alias("trial")).distinct()
    both = of.join(texts.select("trial", F.col("vector").alias("_t")), "trial").join(attributes.select("trial", F.col("vector").alias("_a")), "trial")
    return both.select("key", F.concat("_t", "_a").alias("vector"))


def concept_features(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(concept, etype, vector): members(concept, etype, key) and vectors(key, vector): the mean over the chosen type's members that have one.

    A concept without a type in TYPE_ORDER, or without any vector, has no row.
    Of several types the first in TYPE_ORDER is taken.
    """
    from kgspark.functions.vectors import element_mean

    rank = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("etype"))
    ranked = members.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy("concept").agg(F.min("_rank").alias("_best"))
    chosen = ranked.join(best, "concept").where("_rank = _best")
    return element_mean(chosen.join(vectors, "key"), ["concept", "etype"], "vector")
