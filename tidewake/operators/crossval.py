"""Results of several folds together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(individual: DataFrame) -> DataFrame:
    """split and mean and population standard deviation of each score over the individuals of all folds."""
    names = {"macro_f1": "f1", "macro_precision": "prec", "macro_recall": "rec", "time_scale_ratio": "tsr"}
    return individual.groupBy("split").agg(*(f(c).alias(f"{n}_{k}") for c, n in names.items() if c in individual.columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))))


def summed_labels(labels: DataFrame) -> DataFrame:
    """split, label, truth, predicted summed over folds."""
    return labels.groupBy("split", "label").agg(F.sum("truth").alias("truth"), F.sum("predicted").alias("predicted"))


def individualised(scores: DataFrame) -> DataFrame:
    """split, mean and population standard deviation of macro F1 under each individual's own cluster map, over the individuals of all folds."""
    return scores.groupBy("split").agg(F.avg("macro_f1").alias("f1_individualized_mean"), F.stddev_pop("macro_f1").alias("f1_individualized_std"))


def summed_confusion(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, pred, n over folds, share of the grand total, and share of the true label's row."""
    c = confusion.groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n"))
    every, row = F.sum("n").over(Window.partitionBy(*keys)), F.sum("n").over(Window.partitionBy(*keys, "label"))  # a row for each pair of labels
    return c.select(*keys, "label", "pred", "n", F.when(every > 0, F.col("n") / every).otherwise(0.0).alias("share"), F.when(row > 0, F.col("n") / row).otherwise(0.0).alias("row_share"))


def by_prediction(counts: DataFrame) -> DataFrame:
    """label, pred, share of its prediction's column; empty columns are 0."""
    col = F.sum("n").over(Window.partitionBy("pred"))
    return counts.select("label", "pred", F.when(col > 0, F.col("n") / col).otherwise(0.0).alias("share"))


def best(results: DataFrame, score: str = "macro_f1") -> DataFrame:
    """config_id, score: the highest mean over individuals; of equals the first id."""
    means = results.groupBy("config_id").agg(F.avg(score).alias("score"))
    return means.orderBy(F.desc("score"), "config_id").limit(1)


def pending(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations that have no result yet."""
    return configs.join(results.select("config_id").distinct(), "config_id", "left_anti")
