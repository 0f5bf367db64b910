"""Settings of an evaluation run. Plain driver-side values; no data."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

# Default cost matrix per use case (units are arbitrary, only ratios matter).
DEFAULT_COSTS = {
    "default": {"TP": -1.0, "TN": 0.0, "FP": 2.0, "FN": 5.0},
    "low_fp": {"TP": -1.0, "TN": 0.0, "FP": 10.0, "FN": 3.0},
    "low_fn": {"TP": -1.0, "TN": 0.0, "FP": 2.0, "FN": 20.0},
}


@dataclass(frozen=True)
class SliceRule:
    """A named slice: ``predicate`` is a Spark SQL boolean expression."""

    name: str
    predicate: str
    description: str = ""


@dataclass(frozen=True)
class EvalConfig:
    # Default grid, bins and limits.
    threshold_start: float = 0.05
    threshold_stop: float = 0.95
    threshold_step: float = 0.01
    ece_bins: int = 10
    text_length_bins: tuple = (0, 30, 80, 160, 1000000)
    confidence_bins: tuple = (0.0, 0.5, 0.7, 0.85, 1.01)
    label_freq_bins: tuple = (0.0, 0.01, 0.05, 0.2, 1.01)
    default_threshold: float = 0.5
    uncertain_margin: float = 0.15
    high_confidence: float = 0.8
    min_count: int = 50
    max_ci_width: float = 0.1
    bootstrap_iters: int = 200
    ci_alpha: float = 0.05
    seed: int = 42
    test_size: float = 0.2
    val_size: float = 0.1
    top_errors: int = 25
    min_errors_to_cluster: int = 20
    heatmap_slices: int = 25
    ranking_size: int = 5

    positive_label: int = 1
    id_col: str = "id"
    label_col: str = "label"
    text_col: str | None = "text"
    max_terms: int = 5000
    max_dimensions: int = 50
    max_clusters: int = 6
    top_terms: int = 10
    cluster_examples: int = 5
    auto_slices: bool = True
    difficulty: bool = True
    optimize_threshold: bool = True
    per_slice: bool = True
    per_slice_thresholds: bool = True
    default_use_case: str = "default"
    costs: dict = field(default_factory=lambda: {k: dict(v) for k, v in DEFAULT_COSTS.items()})
    rules: tuple[SliceRule, ...] = ()

    @property
    def thresholds(self) -> list[float]:
        """The threshold grid, both ends included."""
        if not self.optimize_threshold:
            return [self.default_threshold]
        steps = math.ceil((self.threshold_stop + 1e-12 - self.threshold_start) / self.threshold_step)
        return [round(self.threshold_start + i * self.threshold_step, 6) for i in range(steps)]

    @property
    def ece_edges(self) -> list[float]:
        """Bin edges as multiples of the floating-point bin width, last edge exactly 1."""
        width = 1.0 / self.ece_bins
        return [i * width for i in range(self.ece_bins)] + [1.0]

    def costs_of(self, use_cases: list[str] | None = None) -> dict[str, dict[str, float]]:
        if use_cases is None:
            return self.costs
        unknown = [u for u in use_cases if u not in self.costs]
        if unknown:
            raise ValueError(f"unknown use case(s) {unknown}; known: {sorted(self.costs)}")
        return {u: self.costs[u] for u in use_cases}

    def run_id(self, registry: list[dict] | None = None, data: dict | str | None = None) -> str:
        """Twelve hex digits over every setting, costs and rules included, and over the models and the data if given.

        ``registry`` as for ``train_and_score``; ``data`` says what was read: paths and options, or better the fingerprints of the
        tables (``functions.encoding.fingerprint``), which change with any row. Runs that differ in either must not
        share an id: saved predictions are replaced by id.
        """
        known = [{k: v for k, v in m.items() if k != "estimator"} | ({"estimator": type(m["estimator"]).__name__} if "estimator" in m else {}) for m in registry or []]
        extra = ({"models": known} if registry is not None else {}) | ({"data": data} if data is not None else {})
        text = json.dumps(asdict(self) | extra, sort_keys=True, default=str)
        return hashlib.sha256(text.encode("utf-8")).hexdigest()[:12]
