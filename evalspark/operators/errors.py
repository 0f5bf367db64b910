"""Wrong decisions at the chosen threshold: the worst ones, their counts, their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.functions import scores as S
from evalspark.operators.slicing import ALL
from evalspark.operators.order import numbered
from evalspark.operators.text import tokens
from evalspark.sources.predictions import KEYS
from evalspark.storage import materialize


def overall_best(best: DataFrame) -> DataFrame:
    """The best thresholds of whole models from a table that also holds slices."""
    if "slice_name" in best.columns:
        return best.where(F.col("slice_name") == ALL)
    return best.where(F.col("slice_id") == 0)


def errors_at_best(preds: DataFrame, best: DataFrame) -> DataFrame:
    """False positives and false negatives at each model's best threshold.

    ``best`` has one row per model, split and use case, so it is broadcast.
    """
    few = F.broadcast(best.select(*KEYS, "use_case", "best_threshold"))
    vote = S.predicted(F.col("y_score"), F.col("best_threshold"))
    kind = F.when((vote == 1) & (F.col("label") == 0), "FP").when((vote == 0) & (F.col("label") == 1), "FN")
    return (
        preds.join(few, KEYS)
        .withColumn("error_type", kind)
        .where(F.col("error_type").isNotNull())
        .withColumn("confidence", S.confidence(F.col("y_score")))
    )


def top_errors(errors: DataFrame, size: int) -> DataFrame:
    """The most confident errors of each type; the id breaks ties.

    Each task keeps only its own ``size`` best rows per group before the shuffle.
    """
    group = Window.partitionBy(*KEYS, "use_case", "error_type").orderBy(F.col("confidence").desc(), "id")
    return errors.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= size)


def with_text(errors: DataFrame, examples: DataFrame, text_col: str | None) -> DataFrame:
    """Add the text of each error, if there are texts; an error without an example keeps a null."""
    if text_col is None or text_col not in examples.columns:
        return errors
    on = ["id", "split"] if "split" in examples.columns else ["id"]
    return errors.join(examples.select(*on, F.col(text_col).alias("text")), on, "left")


def with_text_of_few(worst: DataFrame, examples: DataFrame, text_col: str | None) -> DataFrame:
    """``with_text`` for a top-k table: its ids are broadcast, so the texts of the other
    examples are dropped where they are read instead of being shuffled.

    Top-k rows are bounded by the settings (k per model, split, use case and error type);
    they are written first because they are used twice.
    """
    if text_col is None or text_col not in examples.columns:
        return worst
    on = ["id", "split"] if "split" in examples.columns else ["id"]
    worst = materialize(worst, "top-errors")
    wanted = F.broadcast(worst.select(*on).distinct())
    return with_text(worst, examples.join(wanted, on), text_col)


def ordered_errors(errors: DataFrame) -> DataFrame:
    """All errors with their ``position``: by model, split and use case, the most confident first, then by id."""
    return numbered(errors, ["model_order", "split", "use_case", F.col("confidence").desc(), "id"])


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy(*KEYS, "use_case").agg(
        F.count("*").alias("error_count"),
        F.count_if(F.col("error_type") == "FP").alias("fp_count"),
        F.count_if(F.col("error_type") == "FN").alias("fn_count"),
    )


def error_distribution(errors: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Errors by type and confidence bin."""
    conf = F.col("confidence")
    name = None
    for low, high in S.bins(cfg.confidence_bins):
        branch = (S.in_bin(conf, low, high), F.lit(S.bin_name("confidence", low, high)))
        name = F.when(*branch) if name is None else name.when(*branch)
    return errors.groupBy(*KEYS, "use_case", "error_type", name.alias("confidence_bin")).agg(
        F.count("*").alias("error_count")
    )


def cluster_status(best: DataFrame, has_text: bool, min_errors: int) -> DataFrame:
    """Per model: can its errors be clustered, and if not, why not.

    The confusion at the best threshold already holds the number of errors.
    """
    few = F.col("error_count") < min_errors
    reason: Column
    if not has_text:
        available, reason = F.lit(False), F.lit("no_text_column")
    else:
        available, reason = ~few, F.when(few, "too_few_errors")
    return best.select(
        *KEYS,
        "use_case",
        (F.col("fp") + F.col("fn")).alias("error_count"),
        F.col("fp").alias("fp_count"),
        F.col("fn").alias("fn_count"),
    ).select("*", available.alias("available"), reason.alias("reason"))


def error_terms(errors: DataFrame, size: int = 10, stop_words: list[str] | None = None) -> DataFrame:
    """The terms found in most errors, per model and error type; ties in order of the term.

    ``errors`` has a ``text``. Terms are counted once per error, over whole texts, and
    the counts are combined before the shuffle.
    """
    group = [*KEYS, "use_case", "error_type"]
    terms = F.explode(F.array_distinct(tokens(F.col("text"), stop_words)))
    counts = errors.select(*group, terms.alias("term")).groupBy(*group, "term").agg(F.count("*").alias("n_errors"))
    order = Window.partitionBy(*group).orderBy(F.col("n_errors").desc(), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
