"""Ratios of counts that never divide by zero, and expected cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(tp: Column, tn: Column, n: Column) -> Column:
    return (tp + tn).cast("double") / n


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp * 2, tp * 2 + fp + fn)


def with_costs(df: DataFrame, costs: dict[str, dict[str, float]]) -> DataFrame:
    """Repeat each row once per use case, with that use case's four costs.

    The cost matrix is a setting, so it enters the plan as a literal array.
    """
    def entry(name: str, c: dict[str, float]) -> str:
        values = ", ".join(f"{float(c[k])!r}D AS cost_{k.lower()}" for k in ("TP", "TN", "FP", "FN"))
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return f"struct('{quoted}' AS use_case, {values})"

    return df.select("*", F.expr("inline(array(" + ", ".join(entry(n, c) for n, c in costs.items()) + "))"))


def expected_cost(tp: Column, tn: Column, fp: Column, fn: Column, n: Column) -> Column:
    """Mean cost per example; the order of the terms is fixed so that ties compare equal."""
    return (
        tp * F.col("cost_tp") + tn * F.col("cost_tn") + fp * F.col("cost_fp") + fn * F.col("cost_fn")
    ) / n
