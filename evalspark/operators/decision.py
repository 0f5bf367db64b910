"""Expected cost over thresholds, the cheapest threshold, and the choice of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.functions import ratios as R
from evalspark.operators.metrics import GROUP, threshold_metrics

COUNTS = ["n", "tn", "fp", "fn", "tp"]


def threshold_confusions(cells: DataFrame, cfg: EvalConfig) -> DataFrame:
    """The confusion at every threshold of the grid, per model, split and slice.

    A row whose bucket is b is predicted positive at the first b thresholds. So a
    running sum over the buckets, from the top, gives the counts, and each bucket
    answers for the thresholds between the next lower bucket and itself.
    """
    top = len(cfg.thresholds)
    grid = F.expr("array(" + ", ".join(f"{t!r}D" for t in cfg.thresholds) + ")")
    positive = F.col("label") == 1
    # Every group also gets an empty top bucket, so that the whole grid is answered for.
    both = F.array(
        F.struct(
            F.col("grid_bucket").alias("bucket"),
            F.when(positive, F.col("n")).otherwise(0).alias("pos"),
            F.when(positive, 0).otherwise(F.col("n")).alias("neg"),
        ),
        F.struct(F.lit(top).alias("bucket"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")),
    )
    hist = cells.select(*GROUP, F.inline(both)).groupBy(*GROUP, "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    whole = Window.partitionBy(*GROUP)
    down = whole.orderBy(F.col("bucket").desc())
    sums = hist.select(
        *GROUP,
        "bucket",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.lead("bucket", 1, 0).over(down).alias("lower"),
        F.sum("pos").over(whole).alias("p"),
        F.sum("neg").over(whole).alias("q"),
    )
    return sums.where(F.col("bucket") > 0).select(
        *GROUP,
        F.explode(F.slice(grid, F.col("lower") + 1, F.col("bucket") - F.col("lower"))).alias("threshold"),
        (F.col("p") + F.col("q")).alias("n"),
        (F.col("q") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("p") - F.col("tp")).alias("fn"),
        "tp",
    )


def cost_curve(cells: DataFrame, cfg: EvalConfig, use_cases: list[str] | None = None) -> DataFrame:
    """Expected cost at every threshold, for every use case asked for."""
    return price(threshold_confusions(cells, cfg), cfg, use_cases)


def price(confusions: DataFrame, cfg: EvalConfig, use_cases: list[str] | None = None) -> DataFrame:
    """Add ``use_case`` and ``expected_cost`` to rows that hold a confusion."""
    priced = R.with_costs(confusions, cfg.costs_of(use_cases))
    cost = R.expected_cost(*[F.col(c) for c in ("tp", "tn", "fp", "fn", "n")])
    return priced.withColumn("expected_cost", cost).drop("cost_tp", "cost_tn", "cost_fp", "cost_fn")


def best_thresholds(curve: DataFrame) -> DataFrame:
    """The cheapest point of each curve; the lowest threshold wins a tie."""
    point = F.min(F.struct("expected_cost", "threshold", *COUNTS)).alias("best")
    return curve.groupBy(*GROUP, "use_case").agg(point).select(
        *GROUP,
        "use_case",
        F.col("best.threshold").alias("best_threshold"),
        F.col("best.expected_cost").alias("expected_cost"),
        *[F.col(f"best.{c}").alias(c) for c in COUNTS],
    )


def metrics_at_best(best: DataFrame) -> DataFrame:
    return threshold_metrics(best)


def rank_models(rows: DataFrame, within: list[str], cost: str = "expected_cost") -> DataFrame:
    """Rank by expected cost; the model registered first wins a tie."""
    order = Window.partitionBy(*within).orderBy(F.col(cost), F.col("model_order"))
    return rows.withColumn("rank", F.row_number().over(order))


def winners(rows: DataFrame, within: list[str]) -> DataFrame:
    return rank_models(rows, within).where(F.col("rank") == 1).drop("rank")


def recommendation(ranked: DataFrame, size: int) -> DataFrame:
    """One row per use case and split: the winner, its threshold, and the head of the ranking."""
    entry = F.struct(
        "rank",
        F.col("model_name").alias("model"),
        "best_threshold",
        "expected_cost",
    )
    return (
        ranked.where(F.col("rank") <= size)
        .groupBy("use_case", "split")
        .agg(
            F.min_by("model_name", "rank").alias("recommended_model"),
            F.min_by("best_threshold", "rank").alias("recommended_threshold"),
            F.sort_array(F.collect_list(entry)).alias("ranking"),
        )
        .withColumn("objective", F.lit("min_expected_cost"))
    )
