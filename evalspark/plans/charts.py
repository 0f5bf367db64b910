"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.slicing import slice_columns
from evalspark.plans.evaluate import Measured
from evalspark.sources.predictions import KEYS


def confidence_accuracy(m: Measured) -> DataFrame:
    """Accuracy at 0.5 over the midpoints of the confidence bins; ``position`` is a midpoint's place in its series."""
    middle = F.array(
        *[F.lit((s.low + s.high) / 2.0 if s.family == "confidence" else None).cast("double") for s in m.slices]
    )[F.col("slice_id")]
    return (
        m.summary()
        .withColumn("confidence_midpoint", middle)
        .where(F.col("confidence_midpoint").isNotNull())
        .withColumn("position", F.row_number().over(Window.partitionBy(*KEYS).orderBy("confidence_midpoint")))  # a row per bin
        .select(*KEYS, "position", "confidence_midpoint", "n", "accuracy")
    )


def slice_cost_matrix(m: Measured, models: list[str], use_case: str | None = None) -> DataFrame:
    """Slices by models, with the expected cost of each; the largest slices of the first model.

    A slice the first model does not have counts 0 there; ties are in order of the name.
    """
    best = m.best([use_case or m.cfg.default_use_case]).where(F.col("slice_id") > 0)
    rows = slice_columns(best, m.slices)
    size = F.max(F.when(F.col("model_name") == models[0], F.col("n")).otherwise(0))
    matrix = rows.groupBy("split", "slice_name").agg(
        size.alias("n"),
        *[F.max(F.when(F.col("model_name") == name, F.col("expected_cost"))).alias(name) for name in models],
    )
    order = Window.partitionBy("split").orderBy(F.col("n").desc(), "slice_name")
    return matrix.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m.cfg.heatmap_slices)
