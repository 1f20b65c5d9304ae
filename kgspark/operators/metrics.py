"""Ranking and classification metrics over long score tables: label_id, example_id, y, p.

Everything starts from counts per (label, score): ties are one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.ordered import running_sums


def _curve(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per label and distinct score, from the best on: positives and negatives here and up to here, and the label's totals.

    Summed by ranges of (label, score), so that a label's scores may be many tasks' work.
    """
    tied = scores.groupBy(*keys, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.desc("p")]
    walked = running_sums(tied, order, {"_tp": F.col("pos"), "_fp": F.col("neg")}, "curve")
    own = walked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_tp").alias("_tp0"), F.min("_fp").alias("_fp0"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = walked.join(own.where("n_pos > 0 and n_neg > 0"), same)
    return met.select(*keys, "p", "pos", "neg", (F.col("_tp") - F.col("_tp0") + F.col("pos")).alias("tp"), (F.col("_fp") - F.col("_fp0") + F.col("neg")).alias("fp"), "n_pos", "n_neg")


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc: the chance that a positive outranks a negative, ties by half; labels of one class are left out."""
    won = F.col("pos") * (F.col("n_neg") - F.col("fp")) + F.col("pos") * F.col("neg") / 2
    return _curve(scores, keys).groupBy(*keys).agg((F.sum(won) / F.first(F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def auprc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auprc: trapezoids over (recall, precision) of the distinct thresholds, from (0, 1) on."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")  # at the threshold before
    curve = _curve(scores, keys).withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "before": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)})
    width, height = F.col("pos") / F.col("n_pos"), (F.col("precision") + F.col("before")) / 2
    return curve.withColumn("area", width * height).groupBy(*keys).agg(F.sum("area").alias("auprc"))


def balanced_auprc(scores: DataFrame, keys: list[str], repeats: int = 10, ratio: int = 1, seed: int = 42) -> DataFrame:
    """keys, balanced_auprc: mean auprc over repeats, each with about ratio negatives a positive, drawn by a seeded hash."""
    counts = scores.groupBy(*keys).agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg")).where("n_pos > 0 and n_neg > 0")
    turns = scores.join(counts, keys).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    part = F.pmod(F.xxhash64(F.lit(seed), "turn", *keys, "example_id"), F.lit(1_000_000)) / 1e6
    drawn = turns.where((F.col("y") == 1) | (part < ratio * F.col("n_pos") / F.col("n_neg")))
    return auprc(drawn, [*keys, "turn"]).groupBy(*keys).agg(F.avg("auprc").alias("balanced_auprc"))


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def label_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    counts = scores.groupBy(*keys).agg(F.sum(F.col("y").cast("long")).alias("n_pos"), F.count("*").alias("n"))
    return counts.join(auroc(scores, keys), keys).join(auprc(scores, keys), keys)


def macro(metrics: DataFrame, floors: tuple = (10, 15, 20), most_ratio: float = 10.0) -> DataFrame:
    """One row: means of auroc and auprc over labels, also weighted by positives and by their logarithm, and over subsets of labels."""
    out = [F.count("*").alias("n_labels")]
    for m in ("auroc", "auprc"):
        w, log_w = F.col("n_pos"), F.log(F.col("n_pos").cast("double"))
        out += [F.avg(m).alias(f"{m}_mean"), (F.sum(F.col(m) * w) / F.sum(w)).alias(f"{m}_weighted"), F.try_divide(F.sum(F.col(m) * log_w), F.sum(log_w)).alias(f"{m}_logweighted")]
        near = (F.col("n") - F.col("n_pos")) / F.col("n_pos") <= most_ratio
        out.append(F.coalesce(F.avg(F.when(near, F.col(m))), F.lit(0.0)).alias(f"{m}_neg_pos_{int(most_ratio)}"))
        out += [F.coalesce(F.avg(F.when(F.col("n_pos") >= k, F.col(m))), F.lit(0.0)).alias(f"{m}_pos_{k}") for k in floors]
    return metrics.agg(*out)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1 of each class met as truth or prediction; 0 where undefined."""
    cells = confusion(rows, truth, predicted)
    hit = cells.where(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("class"), F.col("n").alias("tp"))
    said = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    real = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"))
    joined = real.join(said, "class", "full").join(hit, "class", "left").fillna(0, ["tp", "said", "support"])
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    joined = joined.withColumns({"precision": share(F.col("tp"), F.col("said")), "recall": share(F.col("tp"), F.col("support"))})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return joined.withColumn("f1", f1).select("class", "support", "precision", "recall", "f1")


def averaged(scores: DataFrame) -> DataFrame:
    """weighted and macro precision, recall and f1 of class_scores()."""
    out = []
    for m in ("precision", "recall", "f1"):
        out += [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted"), F.avg(m).alias(f"{m}_macro")]
    return scores.agg(*out)


def ranking(positives: DataFrame, negatives: DataFrame, key: str, hits: tuple = (1, 3, 10)) -> DataFrame:
    """One row: mean reciprocal rank and hits at k; a positive's rank among its negatives averages its best and worst under ties."""
    met = positives.select(key, F.col("score").alias("s")).join(negatives.select(key, F.col("score").alias("o")), key, "left")
    ranks = met.groupBy(key).agg((1 + F.count_if(F.col("o") > F.col("s")) + F.count_if(F.col("o") == F.col("s")) / 2).alias("rank"))
    return ranks.agg(F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in hits])


def positive_weight(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """keys, weight: sqrt(negatives / positives)."""
    return rows.groupBy(*keys).agg(F.sqrt((F.count("*") - F.sum(y)) / F.sum(y)).alias("weight"))
