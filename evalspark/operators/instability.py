"""How far a slice's numbers can be trusted: counts and bootstrap intervals.

Drawing rows with replacement is done by weights: a row counts as often as a Poisson number says, rows that are alike
together. The numbers come from hashes (``functions.draws``), so an interval is the same on any partitioning, and no
Python takes part, but in a metric that the caller gives as a Python function (``bootstrap_metric``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.functions import draws as R
from evalspark.functions.scores import INF
from evalspark.operators.metrics import CONFUSION
from evalspark.operators.ranking import default_buckets, score_ranges

# A metric of resampled confusion counts: columns (tn, fp, fn, tp) -> column; null where it has no value.
ConfusionMetric = Callable[[Column, Column, Column, Column], Column]


def accuracy_metric(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return F.try_divide((tn + tp).cast("double"), (tn + fp + fn + tp).cast("double"))


def low_count_flags(df: DataFrame, min_count: int, count: str = "n") -> DataFrame:
    low = F.col(count) < min_count
    return df.withColumn("unstable", low).withColumn(
        "reason", F.when(low, "low_sample_count").otherwise("stable")
    )


def instability_flags(df: DataFrame, min_count: int, max_width: float, count: str = "n", width: str = "ci_width") -> DataFrame:
    """Few rows, or a wide interval, make a slice unstable; the first reason is named."""
    low, wide = F.col(count) < min_count, F.col(width) > max_width
    reason = F.when(low, "low_sample_count").when(wide, "wide_confidence_interval").otherwise("stable")
    return df.withColumn("unstable", low | F.coalesce(wide, F.lit(False))).withColumn("reason", reason)


def _quantile(ascending: Column, at: float) -> Column:
    """Interpolated between the two values next to the place; null for an empty array."""
    place = (F.size(ascending) - 1) * F.lit(at)
    low = F.greatest(F.floor(place), F.lit(0)).cast("int")
    high = F.greatest(F.least(low + 1, F.size(ascending) - 1), F.lit(0))
    a, b = F.get(ascending, low), F.get(ascending, high)
    return a + (b - a) * (place - low)


def bootstrap_confusion(
    df: DataFrame,
    key: list[str],
    cfg: EvalConfig,
    metric: ConfusionMetric = accuracy_metric,
    names: list[Column] | None = None,
) -> DataFrame:
    """Add ``ci_low``, ``ci_high``, ``ci_width`` for a metric of the confusion counts.

    The rows are counted first and only the four counts are resampled: the work per row of ``df`` does not depend on
    the rows behind it. ``names`` (default: the key columns) tell the groups apart when numbers are drawn.
    Draws in which the metric is null are left out.
    """
    tags = [R.cell_tag(cfg.seed, *(names or [F.col(c) for c in key]), F.lit(c)) for c in CONFUSION]
    counts = [F.col(c).cast("bigint") for c in CONFUSION]

    def once(draw: Column) -> Column:
        return metric(*[R.poisson(n, R.draw_hash(tag, draw)) for n, tag in zip(counts, tags)])

    values = F.transform(F.sequence(F.lit(0), F.lit(cfg.bootstrap_iters - 1)), once)
    drawn = df.withColumn("_drawn", F.array_sort(F.filter(values, lambda v: v.isNotNull())))
    low, high = (_quantile(F.col("_drawn"), at) for at in (cfg.ci_alpha / 2, 1 - cfg.ci_alpha / 2))
    bounds = drawn.withColumn("ci_low", low).withColumn("ci_high", high)
    return bounds.withColumn("ci_width", F.col("ci_high") - F.col("ci_low")).drop("_drawn")


def _interval(draws: DataFrame, key: list[str], value: Column, alpha: float) -> DataFrame:
    at = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    return draws.groupBy(*key).agg(F.percentile(value, at).alias("ci")).select(
        *key, F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"),
        (F.col("ci")[1] - F.col("ci")[0]).alias("ci_width"),
    )


def _tag(key: list[str], cfg: EvalConfig) -> Column:
    """Names the rows of one score and label."""
    return R.cell_tag(cfg.seed, *[F.col(k) for k in key], F.col("label"), R.score_text(F.col("y_score")))


def bootstrap_sums(
    scores: DataFrame, key: list[str], sums: dict[str, Column], metric: Callable[[dict[str, Column]], Column], cfg: EvalConfig
) -> DataFrame:
    """Interval of any metric that is a function of sums over rows.

    ``sums`` are expressions on label and score, ``metric`` combines their totals in a draw (the rows are the sum
    ``w``). The draws are added up in the tasks, so what is shuffled depends on the tasks and the draws, not on the rows.
    """
    cells = scores.groupBy(*key, "y_score", "label").agg(F.count("*").alias("_n"))
    rows = cells.select(*key, _tag(key, cfg).alias("_tag"), "_n", *[c.cast("double").alias(f"_{n}") for n, c in sums.items()])
    w = F.col("weight")
    totals = R.with_draws(rows, cfg.bootstrap_iters, "_n", "_tag").groupBy(*key, "draw").agg(
        F.sum(w).cast("double").alias("w"), *[F.sum(w * F.col(f"_{n}")).alias(n) for n in sums]
    )
    return _interval(totals.where(F.col("w") > 0), key, metric({n: F.col(n) for n in ("w", *sums)}), cfg.ci_alpha)


#: Any metric of a resample: arrays (label, score, weight), scores ascending -> a number, or None where it has none.
SampleMetric = Callable[[np.ndarray, np.ndarray, np.ndarray], float | None]


def bootstrap_metric(scores: DataFrame, key: list[str], metric: SampleMetric, cfg: EvalConfig) -> DataFrame:
    """Interval of any metric, also one that is no function of sums.

    ``metric`` sees one resample of one group at a time, as Arrow batches put together: each distinct label and score
    with how often its rows were drawn. So a task holds the distinct scores of a group, and the shuffle carries them once
    for each draw; metrics that are functions of sums are cheaper by ``bootstrap_sums``. Draws without a value are left out.
    """
    cells = scores.groupBy(*key, "y_score", "label").agg(F.count("*").alias("_n")).withColumn("_tag", _tag(key, cfg))
    drawn = R.with_draws(cells, cfg.bootstrap_iters, "_n", "_tag").where("weight > 0").select(*key, "draw", "label", "y_score", "weight")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.select(*key, "draw").schema.fields]

    def once(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y_score", "label"])
        value = metric(rows["label"].to_numpy(), rows["y_score"].to_numpy(), rows["weight"].to_numpy())
        return rows[[*key, "draw"]].head(1).assign(value=None if value is None else float(value))

    values = drawn.groupBy(*key, "draw").applyInPandas(once, ", ".join([*fields, "value double"]))
    return _interval(values.where(F.col("value").isNotNull()), key, F.col("value"), cfg.ci_alpha)


def bootstrap_mean(scores: DataFrame, key: list[str], value: Column, cfg: EvalConfig) -> DataFrame:
    """Interval of the mean of ``value``, an expression on label and score (the Brier score, say)."""
    return bootstrap_sums(scores, key, {"total": value}, lambda s: s["total"] / s["w"], cfg)


def bootstrap_ece(scores: DataFrame, key: list[str], cfg: EvalConfig) -> DataFrame:
    """Interval of the expected calibration error: per bin the sum of right votes minus scores."""
    score, edges = F.col("y_score"), cfg.ece_edges
    gap = ((score >= 0.5).cast("int") == F.col("label")).cast("int") - score
    sums = {}
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        below = score <= high if i == cfg.ece_bins - 1 else score < high
        sums[f"gap{i}"] = F.when((score >= low) & below, gap).otherwise(0.0)
    return bootstrap_sums(scores, key, sums, lambda s: reduce(Column.__add__, [F.abs(s[n]) for n in sums]) / s["w"], cfg)


def bootstrap_ranking(scores: DataFrame, key: list[str], cfg: EvalConfig) -> DataFrame:
    """Interval of ROC AUC, equal scores counting half.

    Scores are dealt by range; inside a range every draw adds up its negatives from the lowest score on and so counts its
    pairs in order. Pairs across ranges follow from the totals of the ranges. Draws are made after the shuffle, so what
    is shuffled is one row per score, and then one row per range and draw.
    """
    edges = score_ranges(scores, default_buckets(scores))
    ranges = Bucketizer(splits=[-INF, *(edges or [0.5]), INF], inputCol="y_score", outputCol="_bucket")
    cells = ranges.transform(scores).groupBy(*key, "_bucket", "y_score", "label").agg(F.count("*").alias("_n"))
    group = [*key, "_bucket"]
    dealt = cells.withColumn("_tag", _tag(key, cfg)).repartition(*group)
    drawn = R.with_draws(dealt, cfg.bootstrap_iters, "_n", "_tag")
    positive = F.when(F.col("label") == 1, F.col("weight")).otherwise(0)
    negative = F.when(F.col("label") == 1, 0).otherwise(F.col("weight"))
    drawn = drawn.select(*group, "draw", "y_score", "label", positive.alias("p"), negative.alias("q"))
    one = Window.partitionBy(*group, "draw")
    upto = one.orderBy("y_score", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # negatives first
    tied = Window.partitionBy(*group, "draw", "y_score").orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = drawn.withColumn("pairs", F.col("p") * (F.sum("q").over(upto) - F.sum("q").over(tied) / 2))
    inside = pairs.groupBy(*group, "draw").agg(*[F.sum(c).cast("double").alias(c) for c in ("p", "q", "pairs")])
    below = Window.partitionBy(*key, "draw").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = F.col("p") * F.coalesce(F.sum("q").over(below), F.lit(0.0))
    total = (
        inside.withColumn("pairs", F.col("pairs") + across)
        .groupBy(*key, "draw")
        .agg(*[F.sum(c).alias(c) for c in ("p", "q", "pairs")])
        .where("p > 0 and q > 0")
    )
    return _interval(total, key, F.col("pairs") / (F.col("p") * F.col("q")), cfg.ci_alpha)
