"""Classification and calibration metrics from cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.functions import ratios as R
from evalspark.functions import scores as S
from evalspark.operators.cells import SUMS
from evalspark.sources.predictions import KEYS

GROUP = [*KEYS, "slice_id"]
CONFUSION = ["tn", "fp", "fn", "tp"]


def _confusion(hits: str) -> list[Column]:
    """Confusion counts from the rows (``n``) and those predicted positive (``hits``)."""
    positive = F.col("label") == 1
    misses = F.col("n") - F.col(hits)
    return [
        F.sum(F.when(~positive, misses).otherwise(0)).alias("tn"),
        F.sum(F.when(~positive, F.col(hits)).otherwise(0)).alias("fp"),
        F.sum(F.when(positive, misses).otherwise(0)).alias("fn"),
        F.sum(F.when(positive, F.col(hits)).otherwise(0)).alias("tp"),
    ]


def confusion(cells: DataFrame, hits: str = "n_op") -> DataFrame:
    """tn, fp, fn, tp per model, split and slice; ``hits`` is n_op (operating threshold) or n_half (0.5)."""
    return cells.groupBy(*GROUP).agg(F.sum("n").alias("n"), *_confusion(hits))


def threshold_metrics(df: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1 to rows that hold a confusion and ``n``."""
    tn, fp, fn, tp = (F.col(c) for c in CONFUSION)
    return df.select(
        "*",
        R.accuracy(tp, tn, F.col("n")).alias("accuracy"),
        R.precision(tp, fp).alias("precision"),
        R.recall(tp, fn).alias("recall"),
        R.f1(tp, fp, fn).alias("f1"),
    )


def reliability(cells: DataFrame) -> DataFrame:
    """Per calibration bin: rows, accuracy at 0.5 and mean score. Scores outside [0, 1] have no bin."""
    right = F.when(F.col("label") == 1, F.col("n_half")).otherwise(F.col("n") - F.col("n_half"))
    bins = cells.where(F.col("ece_bin").isNotNull()).groupBy(*GROUP, "ece_bin").agg(
        F.sum("n").alias("n"), F.sum(right).alias("n_correct"), F.sum("sum_score").alias("sum_score")
    )
    return bins.select(
        *GROUP,
        "ece_bin",
        "n",
        (F.col("n_correct") / F.col("n")).alias("accuracy"),
        (F.col("sum_score") / F.col("n")).alias("mean_score"),
    )


def summary(cells: DataFrame, hits: str = "n_half") -> DataFrame:
    """Every metric that is a sum, in one row per model, split and slice.

    Aggregates in two levels, first per calibration bin, so that the calibration error
    and the plain means come out of the same pass.
    """
    counts = _confusion(hits)
    right = F.when(F.col("label") == 1, F.col("n_half")).otherwise(F.col("n") - F.col("n_half"))
    bins = cells.groupBy(*GROUP, "ece_bin").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *counts,
        F.sum(right).alias("n_correct"),
        F.min("op_low").alias("op_low"),
        F.max("op_high").alias("op_high"),
    )
    gap = F.abs(F.col("n_correct") / F.col("n") - F.col("sum_score") / F.col("n")) * F.col("n")
    n = F.sum("n")
    groups = bins.groupBy(*GROUP).agg(
        n.alias("n"),
        *[F.sum(c).alias(c) for c in CONFUSION],
        (F.sum("sum_sq") / n).alias("brier"),
        (F.sum("sum_conf") / n).alias("avg_confidence"),
        (F.coalesce(F.sum(F.when(F.col("ece_bin").isNotNull(), gap)), F.lit(0.0)) / n).alias("ece"),
        (F.sum("n_high") / n).alias("high_confidence_share"),
        F.try_divide(F.sum("n_high_correct").cast("double"), F.sum("n_high")).alias("high_confidence_accuracy"),
        F.min("op_low").alias("op_low"),
        F.max("op_high").alias("op_high"),
    )
    if hits == "n_half":
        threshold = F.lit(0.5)
    else:
        threshold = F.when(
            F.col("op_low") < F.col("op_high"),
            F.raise_error(F.lit("a model has more than one operating threshold")).cast("double"),
        ).otherwise(F.col("op_low"))
    return threshold_metrics(groups.withColumn("threshold", threshold)).drop("op_low", "op_high")


def high_confidence(preds: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Share of rows at or above the confidence limit, and how often they are right."""
    score = F.col("y_score")
    high = S.confidence(score) >= cfg.high_confidence
    correct = S.predicted(score, 0.5) == F.col("label")
    return preds.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.count_if(high).alias("n_high"),
        (F.count_if(high) / F.count("*")).alias("high_confidence_share"),
        F.try_divide(F.count_if(high & correct).cast("double"), F.count_if(high)).alias("high_confidence_accuracy"),
    )


def multiclass_metrics(df: DataFrame, keys: list[str], label: str = "label", predicted: str = "y_pred") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the labels seen or predicted.

    Only the class-by-class counts are shuffled; each count feeds its true and its
    predicted class, which gives the per-class sums without a join.
    """
    pairs = df.groupBy(*keys, F.col(label).alias("y"), F.col(predicted).alias("y_hat")).agg(F.count("*").alias("n"))
    hit = F.col("y") == F.col("y_hat")
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col("y_hat").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed")),
    )
    classes = (
        pairs.select(*keys, F.when(hit, F.col("n")).otherwise(0).alias("hits"), F.inline(sides))
        .groupBy(*keys, "class")
        .agg(
            F.sum("actual").alias("actual"),
            F.sum("guessed").alias("guessed"),
            F.sum(F.when(F.col("actual") > 0, F.col("hits")).otherwise(0)).alias("hits"),
        )
    )
    hits, actual, guessed = F.col("hits"), F.col("actual"), F.col("guessed")
    return classes.groupBy(*keys).agg(
        F.sum(actual).alias("n"),
        (F.sum(hits) / F.sum(actual)).alias("accuracy"),
        F.avg(R.ratio(hits, guessed)).alias("precision_macro"),
        F.avg(R.ratio(hits, actual)).alias("recall_macro"),
        F.avg(R.ratio(hits * 2, guessed + actual)).alias("f1_macro"),
    )
