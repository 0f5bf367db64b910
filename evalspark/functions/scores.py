"""Column expressions on labels, scores and texts."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def predicted(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def predicted_class(probabilities: Column) -> Column:
    """Index of the largest probability; the first one wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def positive_score(probabilities: Column) -> Column:
    """P(class 1) of a binary model, the largest probability otherwise."""
    return F.when(F.size(probabilities) == 2, probabilities[1]).otherwise(F.array_max(probabilities))


def confidence(score: Column) -> Column:
    return F.greatest(score, F.lit(1.0) - score)


def is_uncertain(score: Column, margin: float) -> Column:
    return F.abs(score - F.lit(0.5)) < F.lit(margin)


def clean_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_length(text: Column) -> Column:
    return F.length(clean_text(text))


def in_bin(value: Column, low: float, high: float) -> Column:
    return (value >= F.lit(low)) & (value < F.lit(high))


def bin_name(family: str, low: float, high: float) -> str:
    return f"{family}[{low},{high})"


def bins(edges: tuple) -> list[tuple]:
    return list(zip(edges[:-1], edges[1:]))


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on nothing but the given values."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def add_buckets(df: DataFrame, score: str, thresholds: list[float], ece_edges: list[float]) -> DataFrame:
    """Add ``grid_bucket`` (number of thresholds <= score) and ``ece_bin``.

    Both compare with literal edges, so a score on an edge falls where a direct
    comparison puts it. ``ece_bin`` is null outside [0, 1]; its last bin is closed.
    """
    split = Bucketizer(
        splitsArray=[[-INF, *thresholds, INF], [-INF, *ece_edges, INF]],
        inputCols=[score, score],
        outputCols=["grid_bucket", "ece_bin"],
    ).transform(df)
    last = len(ece_edges) - 2
    raw = F.col("ece_bin").cast("int") - 1
    return split.withColumn("grid_bucket", F.col("grid_bucket").cast("int")).withColumn(
        "ece_bin",
        F.when(raw.between(0, last), raw).when(F.col(score) == ece_edges[-1], F.lit(last)),
    )
