"""The evaluation flow and its reports, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.operators import decision as D
from evalspark.operators import errors as E
from evalspark.operators.cells import score_cells, slice_cells
from evalspark.operators.instability import bootstrap_confusion, instability_flags, low_count_flags
from evalspark.operators.metrics import GROUP, summary
from evalspark.operators.ranking import ranking_metrics
from evalspark.operators.slicing import (
    Slice,
    SlicedScores,
    assign_slices,
    label_frequency_ids,
    overall_scores,
    skipped_rules,
    slice_columns,
)
from evalspark.sources.predictions import (
    KEYS,
    rejected_predictions,
    require_unique_ids,
    standard_columns,
    unmatched_predictions,
    valid_predictions,
)
from evalspark.storage import materialize

METRICS = ["threshold", "accuracy", "precision", "recall", "f1", "brier", "ece", "avg_confidence",
           "high_confidence_share", "high_confidence_accuracy", "tn", "fp", "fn", "tp"]


@dataclass
class Measured:
    """Small tables keyed by model, split and slice; ``slice_id`` 0 is the whole."""

    cfg: EvalConfig
    slices: list[Slice]
    cells: DataFrame
    ranking: DataFrame | None
    skipped: list = field(default_factory=list)

    def summary(self, at_operating_threshold: bool = False) -> DataFrame:
        return summary(self.cells, "n_op" if at_operating_threshold else "n_half")

    def curve(self, use_cases: list[str] | None = None) -> DataFrame:
        return D.cost_curve(self.cells, self.cfg, use_cases)

    def best(self, use_cases: list[str] | None = None) -> DataFrame:
        return D.best_thresholds(self.curve(use_cases))


def measure(
    preds: DataFrame,
    examples: DataFrame | None,
    cfg: EvalConfig,
    with_ranking: bool = True,
) -> Measured:
    """Read the scores once into cells and, if asked for, once more into ranking metrics.

    The cells are written to the shared folder because every report reads them. The joined
    scores are written too if ranking needs a second pass over them: one narrow write
    instead of another join. Predictions alone are simply scanned again.
    """
    preds = valid_predictions(preds)
    if examples is None:
        sliced = overall_scores(preds)
    else:
        sliced = assign_slices(preds, examples, cfg)
        if with_ranking:
            kept = [c for c in (*KEYS, "label", "y_score", "threshold", "slice_ids") if c in sliced.scores.columns]
            sliced = SlicedScores(materialize(sliced.scores.select(*kept), "scores"), sliced.slices, sliced.skipped)
    cells = materialize(score_cells(sliced.scores, cfg), "cells")
    ranking = None
    if with_ranking:
        frequencies = None
        if any(s.family == "label_freq" for s in sliced.slices):
            frequencies = label_frequency_ids(cells, sliced.slices)
        ranking = ranking_metrics(sliced.scores, KEYS, frequencies)
    return Measured(cfg, sliced.slices, slice_cells(cells, sliced), ranking, sliced.skipped)


def whole(df: DataFrame) -> DataFrame:
    return df.where(F.col("slice_id") == 0).drop("slice_id")


def overall_report(m: Measured, use_cases: list[str] | None = None) -> DataFrame:
    """Per model: metrics at its operating threshold, and the best threshold per use case."""
    at_op = whole(m.summary(at_operating_threshold=True)).select(*KEYS, "n", *METRICS)
    best = whole(m.best(use_cases)).select(*KEYS, "use_case", "best_threshold", "expected_cost")
    out = at_op.join(best, KEYS)
    return out if m.ranking is None else out.join(whole(m.ranking), KEYS)


def compare(m: Measured, use_cases: list[str] | None = None) -> DataFrame:
    """Models ranked by expected cost at their best threshold; rank 1 is the winner."""
    best = D.metrics_at_best(whole_keep(m.best(use_cases))).select(
        *KEYS, "use_case", "best_threshold", "expected_cost", F.col("f1").alias("f1_at_best"), "n"
    )
    plain = whole(m.summary()).select(*KEYS, "brier", "ece")
    rows = best.join(plain, KEYS)
    if m.ranking is not None:
        rows = rows.join(whole(m.ranking), KEYS)
    return D.rank_models(rows, ["use_case", "split"])


def whole_keep(df: DataFrame) -> DataFrame:
    return df.where(F.col("slice_id") == 0)


def metrics_at_best(m: Measured, use_cases: list[str] | None = None) -> DataFrame:
    """Every metric at the best threshold; those that need no threshold are joined in."""
    best = D.metrics_at_best(whole_keep(m.best(use_cases))).drop("slice_id")
    plain = whole(m.summary()).select(*KEYS, "brier", "ece", "avg_confidence")
    out = best.join(plain, KEYS)
    return out if m.ranking is None else out.join(whole(m.ranking), KEYS)


def slice_table(m: Measured, use_cases: list[str] | None = None, intervals: bool = False) -> DataFrame:
    """Per model and slice: metrics at 0.5, the count, the flag and the cheapest threshold.

    With ``intervals`` the flag also looks at the bootstrap interval of the accuracy. The
    thresholds are left out if ``per_slice_thresholds`` is off.
    """
    rows = m.summary().where(F.col("slice_id") > 0)
    if intervals:
        slice_name = F.array(*[F.lit(s.name) for s in m.slices])[F.col("slice_id")]
        drawn = bootstrap_confusion(rows, GROUP, m.cfg, names=[F.col("model_name"), F.col("split"), slice_name])
        rows = instability_flags(drawn, m.cfg.min_count, m.cfg.max_ci_width)
    else:
        rows = low_count_flags(rows, m.cfg.min_count)
    if m.cfg.per_slice_thresholds:
        best = m.best(use_cases).select(*GROUP, "use_case", "best_threshold", "expected_cost")
        rows = rows.join(best, GROUP)
    if m.ranking is not None:
        rows = rows.join(m.ranking, GROUP)
    return slice_columns(rows, m.slices)


def per_slice_recommendations(m: Measured, use_cases: list[str] | None = None) -> DataFrame:
    """The cheapest model of every slice, its threshold and cost, and the count behind it."""
    best = m.best(use_cases).where(F.col("slice_id") > 0).select(
        *GROUP, "use_case", "best_threshold", "expected_cost", "n"
    )
    chosen = low_count_flags(D.winners(best, ["use_case", "split", "slice_id"]), m.cfg.min_count)
    return slice_columns(chosen, m.slices).select(
        "use_case",
        "split",
        "slice_name",
        F.col("model_name").alias("recommended_model"),
        F.col("best_threshold").alias("recommended_threshold"),
        "expected_cost",
        "n",
        "unstable",
    )


def recommend(m: Measured, use_cases: list[str] | None = None) -> DataFrame:
    return D.recommendation(compare(m, use_cases), m.cfg.ranking_size)


def slice_sizes(m: Measured) -> DataFrame:
    return slice_columns(m.cells.groupBy(*GROUP).agg(F.sum("n").alias("n")), m.slices)


@dataclass
class Evaluation:
    """All reports of a run."""

    run_id: str
    overall: DataFrame
    comparison: DataFrame
    cost_curve: DataFrame
    slices: DataFrame | None
    recommendation: DataFrame
    per_slice: DataFrame | None
    errors: DataFrame
    error_status: DataFrame
    rejected: DataFrame
    unmatched: DataFrame
    skipped_rules: DataFrame
    all_errors: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        names = ("overall", "comparison", "cost_curve", "slices", "recommendation", "per_slice", "errors",
                 "error_status", "rejected", "unmatched", "skipped_rules")
        return {n: getattr(self, n) for n in names if getattr(self, n) is not None}


def evaluate(
    preds: DataFrame,
    examples: DataFrame,
    cfg: EvalConfig,
    use_cases: list[str] | None = None,
    splits: list[str] | None = None,
) -> Evaluation:
    """The whole evaluation of all models, for the given use cases (the default one if none).

    Covers every split unless ``splits`` names some. Without ``per_slice`` the examples
    are not joined at all. ``all_errors`` holds every error with its text, for
    ``error_terms`` and ``error_clusters``; it is not among ``tables()``.
    """
    use_cases = use_cases or [cfg.default_use_case]
    cfg.costs_of(use_cases)
    preds = standard_columns(preds, cfg.id_col, cfg.label_col, cfg.positive_label)
    examples = standard_columns(examples, cfg.id_col, cfg.label_col, cfg.positive_label)
    if splits is not None:
        preds = preds.where(F.col("split").isin(splits))
    if not (cfg.per_slice and cfg.auto_slices and cfg.difficulty):
        require_unique_ids(preds)  # otherwise checked while the models' votes are compared
    m = measure(preds, examples if cfg.per_slice else None, cfg)
    m.ranking = materialize(m.ranking, "ranking")
    best = materialize(m.best(use_cases), "best")
    wrong = E.errors_at_best(valid_predictions(preds), E.overall_best(best))
    worst = E.with_text_of_few(E.top_errors(wrong, cfg.top_errors), examples, cfg.text_col)
    has_text = cfg.text_col is not None and cfg.text_col in examples.columns
    return Evaluation(
        run_id=cfg.run_id(),
        overall=overall_report(m, use_cases),
        comparison=compare(m, use_cases),
        cost_curve=slice_columns(whole_keep(m.curve(use_cases)), m.slices),
        slices=slice_table(m, use_cases) if cfg.per_slice else None,
        recommendation=recommend(m, use_cases),
        per_slice=per_slice_recommendations(m, use_cases) if cfg.per_slice and cfg.per_slice_thresholds else None,
        errors=worst,
        error_status=E.cluster_status(E.overall_best(best), has_text, cfg.min_errors_to_cluster),
        rejected=rejected_predictions(preds),
        unmatched=unmatched_predictions(preds, examples),
        skipped_rules=skipped_rules(m.skipped, preds.sparkSession),
        all_errors=E.with_text(wrong, examples, cfg.text_col),
    )
