"""The histogram behind every metric that is a sum.

One pass over the scores counts rows per (model, split, label, threshold bucket,
calibration bin, set of slices). The number of cells depends on the settings, not on
the data, so the shuffle after the map-side combine is small at any size, and
confusion, calibration, cost curves and slice tables are all derived from the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.functions import scores as S
from evalspark.operators.slicing import SlicedScores, label_frequency_ids, with_label_frequency
from evalspark.sources.predictions import KEYS

SUMS = ["n", "n_op", "n_half", "sum_score", "sum_sq", "sum_conf", "n_high", "n_high_correct"]


def score_cells(scores: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Count and sum the scores per cell; ``slice_ids`` stays an array (rows are not repeated)."""
    score, label = F.col("y_score"), F.col("label")
    op = F.coalesce(F.col("threshold"), F.lit(cfg.default_threshold)) if "threshold" in scores.columns else F.lit(
        cfg.default_threshold)
    conf = S.confidence(score)
    high = conf >= cfg.high_confidence
    correct = S.predicted(score, 0.5) == label
    bucketed = S.add_buckets(scores, "y_score", cfg.thresholds, cfg.ece_edges)
    return bucketed.groupBy(*KEYS, "label", "grid_bucket", "ece_bin", "slice_ids").agg(
        F.count("*").alias("n"),
        F.count_if(score >= op).alias("n_op"),
        F.count_if(score >= 0.5).alias("n_half"),
        F.sum("y_score").alias("sum_score"),
        F.sum((score - label) * (score - label)).alias("sum_sq"),
        F.sum(conf).alias("sum_conf"),
        F.count_if(high).alias("n_high"),
        F.count_if(high & correct).alias("n_high_correct"),
        F.min(op).alias("op_low"),
        F.max(op).alias("op_high"),
    )


def slice_cells(cells: DataFrame, sliced: SlicedScores) -> DataFrame:
    """Repeat each cell once per slice it belongs to, label-frequency slices included."""
    if any(s.family == "label_freq" for s in sliced.slices):
        cells = with_label_frequency(cells, label_frequency_ids(cells, sliced.slices))
    return cells.withColumn("slice_id", F.explode("slice_ids")).drop("slice_ids")
