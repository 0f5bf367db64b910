"""The registered queries: every operator run over whole warehouse tables.

Doubles that are sums of fractions are rounded to six places at the very end, with a
nudge that moves exact half-way values off the boundary, so that the order in which an
engine adds cannot change the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.config import EvalConfig, SliceRule
from evalspark.functions import scores as S
from evalspark.functions.encoding import fingerprint
from evalspark.operators import decision as D
from evalspark.operators import errors as E
from evalspark.operators import features as X
from evalspark.operators import instability as I
from evalspark.operators import metrics as M
from evalspark.operators import models, slicing, text
from evalspark.operators.cells import score_cells, slice_cells
from evalspark.operators.order import level_numbers
from evalspark.operators.ranking import ranking_metrics
from evalspark.operators.splits import exact_split, hash_split
from evalspark.plans import charts
from evalspark.plans import evaluate as P
from evalspark.plans.refusals import refused_inputs as refusals
from evalspark.plans.error_clusters import cluster_checks as checks_of_clusters
from evalspark.plans.error_clusters import error_clusters as cluster_all
from evalspark.sources import examples as ex
from evalspark.sources import predictions as pr
from evalspark.sources import warehouse as W
from evalspark.sources.predictions import KEYS
from evalspark.sources.sinks import FORMATS, read_reports, write_reports
from evalspark.storage import fresh_path, materialize

RULES = (
    SliceRule("label_positive", "label == 1", "Positive examples"),
    SliceRule("label_negative", "label == 0", "Negative examples"),
    SliceRule("region_america", "region == 'AMERICA'", "Region America"),
    SliceRule("high_value", "amount >= 300000", "High order value"),
    SliceRule("web", "channel == 'web'", "Column not in this data set"),
)
CONFIG = EvalConfig(rules=RULES)
DOCS_CONFIG = EvalConfig(rules=RULES[:2])
ALL_COSTS = list(CONFIG.costs)
NUDGE = 1e-10


def r6(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    out = F.round(value + F.lit(NUDGE), 6)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def _orders_cells(spark, sf):
    """Cells of the orders without slices: predictions only, one pass."""
    sliced = slicing.overall_scores(W.orders_predictions(spark, sf))
    return slice_cells(score_cells(sliced.scores, CONFIG), sliced)


def _orders(spark, sf, with_ranking=False) -> P.Measured:
    return P.measure(W.orders_predictions(spark, sf), W.orders_examples(spark, sf), CONFIG, with_ranking)


def _docs(spark, sf) -> P.Measured:
    return P.measure(W.docs_predictions(spark, sf), W.docs_examples(spark, sf), DOCS_CONFIG, False)


NAMES = ["model_name", "split"]


# -- whole-model metrics ------------------------------------------------------------

def confusion_overall(spark, sf):
    return M.confusion(_orders_cells(spark, sf)).select(*NAMES, "n", "tn", "fp", "fn", "tp")


def binary_metrics(spark, sf):
    out = M.threshold_metrics(M.confusion(_orders_cells(spark, sf)))
    return out.select(*NAMES, "n", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


def brier_avgconf(spark, sf):
    return M.summary(_orders_cells(spark, sf)).select(*NAMES, r6("brier"), r6("avg_confidence"))


def high_confidence(spark, sf):
    out = M.high_confidence(W.orders_predictions(spark, sf), CONFIG)
    return out.select(*NAMES, "n", "n_high", r6("high_confidence_share"), r6("high_confidence_accuracy"))


def ece(spark, sf):
    return M.summary(_orders_cells(spark, sf)).select(*NAMES, r6("ece"))


def reliability_bins(spark, sf):
    return M.reliability(_orders_cells(spark, sf)).select(*NAMES, "ece_bin", "n", r6("accuracy"), r6("mean_score"))


def _ranked(preds):
    return ranking_metrics(slicing.overall_scores(preds).scores, KEYS)


def roc_auc(spark, sf):
    return _ranked(W.orders_predictions(spark, sf)).select(*NAMES, r6("roc_auc"))


def average_precision(spark, sf):
    return _ranked(W.orders_predictions(spark, sf)).select(*NAMES, r6("pr_auc"))


def _class_scores() -> Column:
    """Ten class scores from the 64 components of a vector: the sum of every tenth."""
    part = lambda i: F.col("embedding")[i].cast("double")
    return F.array(*[reduce(Column.__add__, [part(i) for i in range(k, 64, 10)]) for k in range(10)])


def multiclass_metrics(spark, sf):
    """The largest class score is the class."""
    df = W.embedding_examples(spark, sf).select(
        F.lit("argmax").alias("model_name"),
        "label",
        S.predicted_class(_class_scores()).alias("y_pred"),
    )
    out = M.multiclass_metrics(df, ["model_name"])
    return out.select("model_name", "n", *[r6(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


def class_decisions(spark, sf):
    """Chosen class and score of a multiclass model, per row."""
    p = F.col("p")
    return W.embedding_examples(spark, sf).select("id", "label", _class_scores().alias("p")).select(
        "id", "label", S.predicted_class(p).alias("y_pred"), r6(S.positive_score(p).cast("double"), "y_score")
    )


# -- decisions ----------------------------------------------------------------------

def expected_cost(spark, sf):
    out = D.price(M.confusion(_orders_cells(spark, sf)), CONFIG)
    return out.select(*NAMES, "use_case", r6("expected_cost"))


def cost_curve(spark, sf):
    return D.cost_curve(_orders_cells(spark, sf), CONFIG).select(
        *NAMES, "use_case", "threshold", "tn", "fp", "fn", "tp", r6("expected_cost")
    )


def best_threshold(spark, sf):
    best = D.best_thresholds(D.cost_curve(_orders_cells(spark, sf), CONFIG))
    return best.select(*NAMES, "use_case", "best_threshold", r6("expected_cost"))


def metrics_at_best(spark, sf):
    m = P.measure(W.orders_predictions(spark, sf), None, CONFIG)
    out = P.metrics_at_best(m)
    return out.select(
        *NAMES, "use_case", "best_threshold", r6("expected_cost"), "n", "tn", "fp", "fn", "tp",
        *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "brier", "ece", "avg_confidence", "roc_auc", "pr_auc")],
    )


def model_ranking(spark, sf):
    m = P.measure(W.orders_predictions(spark, sf), None, CONFIG)
    return P.compare(m, ["default"]).select(
        "rank", *NAMES, "best_threshold", "n",
        *[r6(c) for c in ("expected_cost", "f1_at_best", "roc_auc", "pr_auc", "brier", "ece")],
    )


def winner_by_use_case(spark, sf):
    best = D.best_thresholds(D.cost_curve(_orders_cells(spark, sf), CONFIG))
    return D.winners(best, ["use_case", "split"]).select(
        "use_case", *NAMES, "best_threshold", r6("expected_cost")
    )


def operating_threshold(spark, sf):
    """Model b is run at 0.26, model a has no threshold of its own."""
    own = F.when(F.col("model_name") == "model_b", F.lit(0.26))
    preds = W.orders_predictions(spark, sf).withColumn("threshold", own)
    sliced = slicing.overall_scores(preds)
    out = M.summary(slice_cells(score_cells(sliced.scores, CONFIG), sliced), "n_op")
    return out.select(*NAMES, "threshold", "tn", "fp", "fn", "tp", r6("accuracy"), r6("f1"))


def recommendation(spark, sf):
    m = P.measure(W.orders_predictions(spark, sf), None, CONFIG, with_ranking=False)
    out = P.recommend(m)
    runner = F.col("ranking")[1]
    return out.select(
        "use_case", "split", "objective", "recommended_model", "recommended_threshold",
        F.size("ranking").cast("int").alias("ranked_models"),
        runner["model"].alias("second_model"),
        r6(runner["expected_cost"], "second_cost"),
    )


# -- slices -------------------------------------------------------------------------

def slice_membership(spark, sf):
    preds, examples = W.orders_predictions(spark, sf), W.orders_examples(spark, sf)
    sliced = slicing.assign_slices(preds, examples, CONFIG)
    counts = sliced.scores.groupBy(*KEYS, "label").agg(F.count("*").alias("n"))
    scores = slicing.with_label_frequency(sliced.scores, slicing.label_frequency_ids(counts, sliced.slices))
    rows = scores.withColumn("slice_id", F.explode("slice_ids"))
    return slicing.slice_columns(rows, sliced.slices).select(*NAMES, "id", "slice_name")


def slice_sizes(spark, sf):
    return P.slice_sizes(_orders(spark, sf)).select(*NAMES, "slice_name", "n")


def slice_metrics(spark, sf):
    out = P.slice_table(_orders(spark, sf, with_ranking=True), ["default"])
    return out.select(
        *NAMES, "slice_name", "n", "tn", "fp", "fn", "tp", "best_threshold",
        *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "brier", "ece", "avg_confidence",
                          "roc_auc", "pr_auc", "expected_cost")],
    )


def slice_costs(spark, sf):
    m = _orders(spark, sf)
    return slicing.slice_columns(m.best(), m.slices).select(
        *NAMES, "slice_name", "use_case", "n", "best_threshold", r6("expected_cost")
    )


def slice_recommendation(spark, sf):
    return P.per_slice_recommendations(_orders(spark, sf)).select(
        "use_case", "split", "slice_name", "recommended_model", "recommended_threshold", r6("expected_cost"), "n", "unstable"
    )


def instability_flags(spark, sf):
    m = _docs(spark, sf)
    sizes = I.low_count_flags(m.cells.groupBy(*M.GROUP).agg(F.sum("n").alias("n")), DOCS_CONFIG.min_count)
    return slicing.slice_columns(sizes, m.slices).select(*NAMES, "slice_name", "n", "unstable", "reason")


def text_length_slices(spark, sf):
    m = _docs(spark, sf)
    out = P.slice_table(m, ["default"]).where(F.col("slice_name").startswith("text_len"))
    return out.select(*NAMES, "slice_name", "n", "best_threshold",
                      *[r6(c) for c in ("accuracy", "f1", "brier", "ece", "expected_cost")])


def difficulty_disagreement(spark, sf):
    same_id = Window.partitionBy("id", "split")
    voted = W.orders_predictions(spark, sf).withColumn("difficulty_hard", slicing.models_disagree(same_id, F.col("y_score")))
    return voted.where(F.col("model_order") == 0).select("split", "id", "difficulty_hard")


def single_model_slices(spark, sf):
    """One model has nobody to disagree with: its hard examples are those with a score near 0.5."""
    alone = W.orders_predictions(spark, sf).where(F.col("model_name") == "model_a")
    m = P.measure(alone, W.orders_examples(spark, sf), CONFIG, with_ranking=False)
    out = P.slice_table(m, ["low_fp"]).where(F.col("slice_name").endswith("_examples"))
    return out.select(*NAMES, "slice_name", "use_case", "n", "best_threshold", r6("accuracy"), r6("expected_cost"))


def label_frequency(spark, sf):
    counts = W.orders_predictions(spark, sf).groupBy(*KEYS, "label").agg(F.count("*").alias("n"))
    return slicing.label_frequency_ids(counts, []).select(*NAMES, "label", "n", r6("label_freq"))


def evaluation_overall(spark, sf):
    """Joined with the examples, at the operating threshold, for every use case."""
    out = P.overall_report(_orders(spark, sf))
    return out.select(*NAMES, "use_case", "n", "threshold", "best_threshold",
                      *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "brier", "ece", "expected_cost")])


def evaluate_report(spark, sf):
    """The whole flow from one call, its eleven reports as (report, model_name, item, value).

    Scored are all documents by model b and the labelled ones by both models; examples are the English documents. So
    some scores have no label and are rejected, and others have no example and are in no slice by text.
    """
    plain = W.docs_predictions(spark, sf)
    without = W.docs_unlabelled_predictions(spark, sf).where(F.col("label").isNull()).withColumn("model_order", F.lit(1))
    examples = W.docs_examples(spark, sf).where(F.col("lang") == "en")
    run = P.evaluate(plain.unionByName(without), examples, DOCS_CONFIG)

    def item(name: str, df: DataFrame, *pairs: tuple) -> DataFrame:
        pairs = [F.struct(F.lit(k).alias("item") if isinstance(k, str) else k.alias("item"), v.cast("double").alias("value")) for k, v in pairs]
        return df.select(F.lit(name).alias("report"), "model_name", F.inline(F.array(*pairs)))

    count = F.count("*").alias("n")
    status = run.error_status
    parts = [
        item("overall", run.overall, ("n", F.col("n")), ("accuracy", r6(F.col("accuracy")))),
        item("comparison", run.comparison, ("rank", F.col("rank")), ("expected_cost", r6(F.col("expected_cost")))),
        item("recommendation", run.recommendation.withColumnRenamed("recommended_model", "model_name"), ("threshold", F.col("recommended_threshold"))),
        item("cost_curve", run.cost_curve.groupBy("model_name").agg(count), ("points", F.col("n"))),
        item("slices", run.slices, (F.col("slice_name"), F.col("n"))),
        item("per_slice", run.per_slice.withColumnRenamed("recommended_model", "model_name"), (F.col("slice_name"), r6(F.col("expected_cost")))),
        item("error_status", status, ("FP", F.col("fp_count")), ("FN", F.col("fn_count"))).where(F.col("value") > 0),
        item("all_errors", run.all_errors.groupBy("model_name").agg(count), ("n", F.col("n"))),
        item("errors", run.errors.groupBy("model_name", "error_type").agg(count), (F.col("error_type"), F.col("n"))),
        item("rejected", run.rejected.groupBy("model_name", "reject_reason").agg(count), (F.col("reject_reason"), F.col("n"))),
        item("unmatched", run.unmatched.where(F.col("label").isNotNull()).groupBy("model_name").agg(count), ("n", F.col("n"))),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- charts -------------------------------------------------------------------------

def confidence_accuracy(spark, sf):
    out = charts.confidence_accuracy(_orders(spark, sf))
    return out.select(*NAMES, "position", r6("confidence_midpoint"), "n", r6("accuracy"))


def slice_cost_matrix(spark, sf):
    out = charts.slice_cost_matrix(_orders(spark, sf), W.MODELS)
    return out.select("split", "slice_name", "rank", "n", *[r6(m) for m in W.MODELS])


def error_distribution(spark, sf):
    return E.error_distribution(_orders_errors(spark, sf), CONFIG).select(
        *NAMES, "use_case", "error_type", "confidence_bin", "error_count"
    )


# -- errors -------------------------------------------------------------------------

def _orders_errors(spark, sf, use_cases=None):
    best = D.best_thresholds(D.cost_curve(_orders_cells(spark, sf), CONFIG, use_cases))
    return E.errors_at_best(W.orders_predictions(spark, sf), best)


def _docs_best(spark, sf):
    sliced = slicing.overall_scores(W.docs_predictions(spark, sf))
    cells = slice_cells(score_cells(sliced.scores, DOCS_CONFIG), sliced)
    return D.best_thresholds(D.cost_curve(cells, DOCS_CONFIG, ["default"]))


def _docs_errors(spark, sf):
    wrong = E.errors_at_best(W.docs_predictions(spark, sf), _docs_best(spark, sf))
    return E.with_text(wrong, W.docs_examples(spark, sf), "text")


def top_errors(spark, sf):
    worst = E.top_errors(_orders_errors(spark, sf), CONFIG.top_errors)
    return E.with_text_of_few(worst, W.orders_examples(spark, sf), "text").select(
        *NAMES, "use_case", "error_type", "rank", "id", "y_score", r6("confidence"), "text"
    )


def error_order(spark, sf):
    """Errors of the orders in one global order, which is a column of the table."""
    return E.ordered_errors(_orders_errors(spark, sf)).select("position", *NAMES, "use_case", "error_type", "id", "y_score")


def error_counts(spark, sf):
    return E.error_counts(_orders_errors(spark, sf)).select(*NAMES, "use_case", "error_count", "fp_count", "fn_count")


def cluster_status(spark, sf):
    return E.cluster_status(_docs_best(spark, sf), True, DOCS_CONFIG.min_errors_to_cluster).drop("model_order")


def error_terms(spark, sf):
    return E.error_terms(_docs_errors(spark, sf)).select(
        *NAMES, "use_case", "error_type", "rank", "term", "n_errors"
    )


def token_counts(spark, sf):
    """Words and word pairs of every document."""
    return W.table(spark, sf, "documents").select(
        "doc_id",
        F.size(text.words(F.col("text"))).alias("n_words"),
        F.size(F.array_distinct(text.tokens(F.col("text")))).alias("n_distinct_tokens"),
    )


def error_clusters(spark, sf):
    found = cluster_all(_docs_errors(spark, sf), DOCS_CONFIG)
    if found is None:
        empty = "model_name string, split string, use_case string, cluster int, error_count bigint, fp_count bigint, fn_count bigint, top_terms string"
        return spark.createDataFrame([], empty)
    return found.select(
        *NAMES, "use_case", "cluster", "error_count", "fp_count", "fn_count",
        F.concat_ws(", ", "top_terms").alias("top_terms"),
        F.size("examples").alias("n_examples"),
    )


# -- intervals ----------------------------------------------------------------------

def bootstrap_intervals(spark, sf):
    """Accuracy at 0.5 with its interval and the flag, per slice."""
    m = _orders(spark, sf)
    out = P.slice_table(P.Measured(CONFIG, m.slices, m.cells, None), ["default"], intervals=True)
    return out.select(*NAMES, "slice_name", "n", *[r6(c) for c in ("accuracy", "ci_low", "ci_high", "ci_width")], "unstable", "reason")


def _rounded_interval(ci):
    return ci.select(*NAMES, *[r6(c) for c in ("ci_low", "ci_high", "ci_width")])


def _brier_interval(preds):
    p, y = F.col("y_score"), F.col("label")
    return I.bootstrap_mean(preds, KEYS, (p - y) * (p - y), CONFIG)


def bootstrap_brier(spark, sf):
    return _rounded_interval(_brier_interval(W.orders_predictions(spark, sf)))


def bootstrap_auc(spark, sf):
    return _rounded_interval(I.bootstrap_ranking(W.orders_predictions(spark, sf), KEYS, CONFIG))


def bootstrap_ece(spark, sf):
    return _rounded_interval(I.bootstrap_ece(W.orders_predictions(spark, sf), KEYS, CONFIG))


def _median_of_positives(label, score, weight):
    """The lowest score that half of the drawn positives do not exceed."""
    score, weight = score[label == 1], weight[label == 1]
    return score[np.searchsorted(np.cumsum(weight) * 2, weight.sum())] if len(score) else None


def bootstrap_median(spark, sf):
    """Interval of a metric that is no function of sums, given as a Python function."""
    return _rounded_interval(I.bootstrap_metric(W.orders_predictions(spark, sf), KEYS, _median_of_positives, CONFIG))


def interval_bounds(spark, sf):
    """Where the estimates lie in their intervals: as a share of the width, and whether inside."""
    preds = W.orders_predictions(spark, sf)
    out = _ranked(preds).join(M.summary(_orders_cells(spark, sf)).select(*KEYS, "brier"), KEYS)
    columns = []
    for name, ci in {"roc_auc": I.bootstrap_ranking(preds, KEYS, CONFIG), "brier": _brier_interval(preds)}.items():
        out = out.join(ci.select(*KEYS, F.col("ci_low").alias(f"{name}_low"), F.col("ci_high").alias(f"{name}_high")), KEYS)
        place = (F.col(name) - F.col(f"{name}_low")) / (F.col(f"{name}_high") - F.col(f"{name}_low"))
        columns += [r6(place, f"{name}_place"), F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")).alias(f"{name}_inside")]
    return out.select(*NAMES, *columns)


def interval_flags(spark, sf):
    """Slices by count and by the width of the normal interval of their accuracy."""
    m = _orders(spark, sf)
    rows = m.summary().where(F.col("slice_id") > 0)
    width = 2 * 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    flagged = I.instability_flags(rows.withColumn("ci_width", width), CONFIG.min_count, CONFIG.max_ci_width)
    return slicing.slice_columns(flagged, m.slices).select(*NAMES, "slice_name", "n", r6("ci_width"), "unstable", "reason")


def error_tfidf(spark, sf):
    """The TF-IDF matrix of every model's errors as rows."""
    errors = _docs_errors(spark, sf).withColumn("tokens", text.tokens(F.col("text")))
    enough = E.cluster_status(_docs_best(spark, sf), True, DOCS_CONFIG.min_errors_to_cluster).where("available").select(*NAMES, "use_case")
    rows = text.tfidf_rows(errors.join(enough, [*NAMES, "use_case"]), [*NAMES, "use_case"], DOCS_CONFIG.max_terms)
    return rows.select(*NAMES, "use_case", "id", "term", "count", r6("weight"))


def error_cluster_checks(spark, sf):
    """Are all errors with their nearest centre, the leading terms those of plain sums, and the latent space one?"""
    found = checks_of_clusters(_docs_errors(spark, sf), DOCS_CONFIG)
    if found is None:
        return spark.createDataFrame([], "model_name string, split string, n bigint, n_misplaced bigint, n_other_terms bigint, n_clusters int, total double, sound boolean")
    sound = (F.col("skew") < 1e-6) & (F.col("off") < 1e-6) & (F.col("captured") <= F.col("total") + 1e-6)
    return found.select(*NAMES, "n", "n_misplaced", "n_other_terms", "n_clusters", r6("total"), sound.alias("sound"))


# -- sources, splits, features, models ----------------------------------------------

def clean_examples(spark, sf):
    """Event rows without their key: duplicates go, rows without a label go."""
    events = W.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_type", F.floor("value").cast("int").alias("amount"),
        F.when(F.col("event_type") != "view", (F.col("event_type") == "error").cast("int")).alias("label"),
    )
    return ex.clean_examples(events)


def content_id(spark, sf):
    lines = W.table(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return ex.clean_examples(lines).select("id", "label")


def table_fingerprint(spark, sf):
    """What stands for the rows of two tables in a run's id."""
    tables = {"orders": W.table(spark, sf, "orders"), "labels": W.table(spark, sf, "labels")}
    return reduce(DataFrame.unionAll, [fingerprint(df).select(F.lit(name).alias("table_name"), "n_rows", "fingerprint") for name, df in tables.items()])


def level_dictionary(spark, sf):
    """Customers as a category with a level per row: their names numbered, joined back to the orders and counted."""
    customers = W.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("/", "c_mktsegment", "c_name").alias("customer"))
    orders = W.table(spark, sf, "orders").join(customers, "o_custkey", "left")
    placed = X.place_levels(orders, ["customer"], {"customer": level_numbers(customers, "customer")})
    return placed.groupBy("customer", F.col("customer__place").alias("number")).agg(F.count("*").alias("n_orders"))


def report_roundtrip(spark, sf):
    """Two report tables of a run, written in every format with a manifest, and read back."""
    path, run = fresh_path(spark, "reports"), CONFIG.run_id()
    best = D.best_thresholds(D.cost_curve(_orders_cells(spark, sf), CONFIG)).select(*NAMES, "use_case", "best_threshold", "n")
    tables = {"best": best, "counts": best.groupBy("use_case").agg(F.count("*").alias("models"))}
    back = []
    for fmt in FORMATS:
        write_reports(tables, f"{path}/{fmt}", run, fmt)
        found = read_reports(spark, f"{path}/{fmt}", run, {name: df.schema for name, df in tables.items()})
        back.append(found["best"].join(found["counts"], "use_case").withColumn("format", F.lit(fmt)))
    return reduce(DataFrame.unionByName, back)


def csv_roundtrip(spark, sf):
    """Orders written as CSV, read back with a schema, cleaned."""
    path = fresh_path(spark, "csv")
    source = W.orders_examples(spark, sf)
    source.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    back = ex.load(spark, ex.csv_loader(path, source.schema))
    return back.groupBy("split", "region", "label").agg(
        F.count("*").alias("n"), r6(F.sum("amount"), "amount"), F.sum(F.length("text")).alias("text_chars")
    )


def predictions_roundtrip(spark, sf):
    """Predictions written per run, model and split; only one model's test split is read back."""
    path = fresh_path(spark, "predictions")
    pr.save_predictions(W.orders_predictions(spark, sf), path, CONFIG.run_id())
    back = pr.load_predictions(spark, path, CONFIG.run_id(), ["model_b"], ["test"])
    return back.select("id", "label", "y_score", "model_name", "split")


def rejected_labels(spark, sf):
    """Documents without a label cannot be scored."""
    return pr.rejected_predictions(W.docs_unlabelled_predictions(spark, sf)).select("id", "model_name", "y_score", "reject_reason")


def unmatched_predictions(spark, sf):
    """Scored documents that are not among the labelled examples."""
    preds = W.docs_unlabelled_predictions(spark, sf)
    return pr.unmatched_predictions(preds, W.docs_examples(spark, sf)).select("id", "model_name", "y_score")


def hash_splits(spark, sf):
    return W.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), hash_split(F.col("o_orderkey")).alias("split")
    )


def exact_splits(spark, sf):
    return exact_split(W.orders_scores(spark, sf).select("id", "label")).select("id", "label", "split")


def one_hot(spark, sf):
    rows = W.orders_examples(spark, sf).select("id", "label", "split", "amount", "region")
    wide = X.one_hot(rows, X.category_levels(rows, ["region"]))
    names = [c for c in wide.columns if c.startswith("region_")]
    return wide.select("id", r6("amount"), *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in names])


# The parameters of the three models. The third is off by default; here it runs with all of its rounds.
REGISTRY = [
    {"name": "logreg", "type": "logistic_regression", "params": {"C": 1.0, "max_iter": 500}},
    {"name": "rf", "type": "random_forest", "params": {"n_estimators": 300, "max_depth": None, "random_state": 42}},
    {"name": "xgb", "type": "boosted_trees", "params": {"n_estimators": 400, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "random_state": 42}},
]
# Labelled rows that a fit of these two queries sees at most; every row is scored.
TRAINING_ROWS = 1000


def train_score(spark, sf):
    """Three models trained on orders and scored on all splits, summed up per model and split."""
    rows = W.orders_examples(spark, sf)
    scored = models.train_and_score(X.encode(rows), REGISTRY, most_rows=TRAINING_ROWS)
    return scored.groupBy(*NAMES).agg(
        F.count("*").alias("n"), F.min("y_score").alias("min_score"), F.max("y_score").alias("max_score"),
        F.avg((F.col("y_score") - F.col("label")) ** 2).alias("brier"),
    )


def train_score_vectors(spark, sf):
    """A model on 64-dimensional vectors, ranked by the engine's own metrics."""
    rows = W.embedding_examples(spark, sf)
    wide = rows.select(
        "id", (F.col("label") < 5).cast("int").alias("label"), hash_split(F.col("id")).alias("split"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)],
    )
    scored = models.train_and_score(X.encode(wide, text_col=None), REGISTRY, most_rows=TRAINING_ROWS)
    return _ranked(scored).drop("slice_id", "model_order")


def logistic_checks(spark, sf):
    """Is the fitted logistic regression at the optimum, and does its saved copy score alike?"""
    encoded = materialize(X.encode(W.orders_examples(spark, sf)), "features")
    train = materialize(encoded.where("split = 'train'").orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS), "training-rows")
    ((_, estimator),) = models.build_models(REGISTRY[:1], train.count())
    fitted = estimator.fit(train)
    path = fresh_path(spark, "model")
    fitted.write().overwrite().save(path)
    scored, again = (models.score(m, encoded, "logreg", 0) for m in (fitted, models.load_model(REGISTRY[0]["type"], path)))
    gradient = models.logistic_gradient(fitted, train, estimator.getRegParam())
    scale = train.select(vector_to_array("features").alias("f")).agg(F.max(F.array_max(F.transform("f", F.abs))).alias("scale"))  # features are as they are
    steep = F.array_max(F.transform("gradient", F.abs)) / F.col("scale")
    at = gradient.crossJoin(scale).select(F.col("n").alias("n_train"), (steep < 1e-4).alias("at_optimum"))
    return at.crossJoin(models.score_differences(scored, again).withColumnRenamed("n", "n_scored"))


def refused_inputs(spark, sf):
    """What a run on the lines of orders would refuse: rules, and columns among the features."""
    rules = (*RULES, SliceRule("sum", "l_quantity + l_tax"), SliceRule("broken", "l_quantity >"), SliceRule("small", "l_quantity < 5"))
    lines = W.table(spark, sf, "lineitem").withColumn("amount", F.col("l_extendedprice"))
    return refusals(lines, EvalConfig(rules=rules))


# -- line items: larger tables, no id ------------------------------------------------

def lineitem_cost_curve(spark, sf):
    sliced = slicing.overall_scores(W.lineitem_predictions(spark, sf))
    cells = slice_cells(score_cells(sliced.scores, CONFIG), sliced)
    return D.cost_curve(cells, CONFIG).select(*NAMES, "use_case", "threshold", r6("expected_cost"))


def lineitem_roc_auc(spark, sf):
    return _ranked(W.lineitem_predictions(spark, sf)).select(*NAMES, r6("roc_auc"), r6("pr_auc"))


QUERIES = {
    "confusion_overall": confusion_overall,
    "binary_metrics": binary_metrics,
    "brier_avgconf": brier_avgconf,
    "high_confidence": high_confidence,
    "ece": ece,
    "reliability_bins": reliability_bins,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "multiclass_metrics": multiclass_metrics,
    "class_decisions": class_decisions,
    "expected_cost": expected_cost,
    "cost_curve": cost_curve,
    "best_threshold": best_threshold,
    "metrics_at_best": metrics_at_best,
    "model_ranking": model_ranking,
    "winner_by_use_case": winner_by_use_case,
    "operating_threshold": operating_threshold,
    "recommendation": recommendation,
    "slice_membership": slice_membership,
    "slice_sizes": slice_sizes,
    "slice_metrics": slice_metrics,
    "slice_costs": slice_costs,
    "slice_recommendation": slice_recommendation,
    "instability_flags": instability_flags,
    "text_length_slices": text_length_slices,
    "difficulty_disagreement": difficulty_disagreement,
    "label_frequency": label_frequency,
    "single_model_slices": single_model_slices,
    "evaluation_overall": evaluation_overall,
    "evaluate_report": evaluate_report,
    "confidence_accuracy": confidence_accuracy,
    "slice_cost_matrix": slice_cost_matrix,
    "error_distribution": error_distribution,
    "top_errors": top_errors,
    "error_order": error_order,
    "error_counts": error_counts,
    "cluster_status": cluster_status,
    "error_terms": error_terms,
    "token_counts": token_counts,
    "error_clusters": error_clusters,
    "bootstrap_intervals": bootstrap_intervals,
    "bootstrap_brier": bootstrap_brier,
    "bootstrap_auc": bootstrap_auc,
    "bootstrap_ece": bootstrap_ece,
    "bootstrap_median": bootstrap_median,
    "interval_bounds": interval_bounds,
    "interval_flags": interval_flags,
    "error_tfidf": error_tfidf,
    "error_cluster_checks": error_cluster_checks,
    "clean_examples": clean_examples,
    "content_id": content_id,
    "table_fingerprint": table_fingerprint,
    "level_dictionary": level_dictionary,
    "report_roundtrip": report_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "predictions_roundtrip": predictions_roundtrip,
    "rejected_labels": rejected_labels,
    "unmatched_predictions": unmatched_predictions,
    "hash_split": hash_splits,
    "exact_split": exact_splits,
    "one_hot": one_hot,
    "train_score": train_score,
    "train_score_vectors": train_score_vectors,
    "logistic_checks": logistic_checks,
    "refused_inputs": refused_inputs,
    "lineitem_cost_curve": lineitem_cost_curve,
    "lineitem_roc_auc": lineitem_roc_auc,
}
