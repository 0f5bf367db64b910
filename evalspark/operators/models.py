"""Baseline models and the scores they give."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.scores import positive_score
from evalspark.storage import materialize

logger = logging.getLogger(__name__)

# Spark grows trees to this depth at most; it stands for "unlimited".
MAX_DEPTH = 30


def logistic_regression(params: dict, n_train: int) -> Estimator:
    """L2 penalty 1/C on the summed loss, i.e. 1/(C n) on Spark's mean loss; features as they are."""
    return LogisticRegression(
        regParam=1.0 / (float(params.get("C", 1.0)) * n_train),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=int(params.get("max_iter", 100)),
    )


def random_forest(params: dict, n_train: int) -> Estimator:
    return RandomForestClassifier(
        numTrees=int(params.get("n_estimators", 100)),
        maxDepth=int(params.get("max_depth") or MAX_DEPTH),
        seed=int(params.get("random_state", 42)),
    )


def boosted_trees(params: dict, n_train: int) -> Estimator:
    return GBTClassifier(
        maxIter=int(params.get("n_estimators", 100)),
        maxDepth=int(params.get("max_depth", 6)),
        stepSize=float(params.get("learning_rate", 0.3)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(params.get("colsample_bytree", "all")),
        seed=int(params.get("random_state", 42)),
    )


# The model types a registry entry may name.
BUILDERS = {
    "logistic_regression": logistic_regression,
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
}

MODELS = {
    "logistic_regression": LogisticRegressionModel,
    "random_forest": RandomForestClassificationModel,
    "boosted_trees": GBTClassificationModel,
}


def build_models(registry: list[dict], n_train: int) -> list[tuple[str, Estimator]]:
    """(name, estimator) for every enabled entry, in order. An entry may bring its own ``estimator``."""
    out = []
    for item in registry:
        if item.get("enabled") is False:
            continue
        if "estimator" in item:
            out.append((item["name"], item["estimator"]))
            continue
        if item["type"] not in BUILDERS:
            raise ValueError(f"unknown model type '{item['type']}'; known: {sorted(BUILDERS)}")
        out.append((item["name"], BUILDERS[item["type"]](item.get("params") or {}, n_train)))
    if len(out) < 2:
        logger.warning("%d model(s) enabled: a comparison needs at least two", len(out))
    return out


def load_model(kind: str, path: str) -> Model:
    """A model saved by ``train_and_score``; ``kind`` is its type in the registry."""
    return MODELS[kind].load(path)


def score(model: Model, encoded: DataFrame, name: str, order: int) -> DataFrame:
    """Prediction rows of one model over every split."""
    p = vector_to_array(F.col("probability"))
    return model.transform(encoded).select(
        F.lit(name).alias("model_name"),
        F.lit(order).alias("model_order"),
        "split",
        "id",
        "label",
        positive_score(p).alias("y_score"),
    )


def logistic_gradient(model: LogisticRegressionModel, rows: DataFrame, regularisation: float) -> DataFrame:
    """(n, gradient): the mean loss' gradient with its L2 penalty at the model's coefficients, the intercept's last.

    One pass over ``rows`` (features, label): features are summed with the errors p - y as weights, those above and
    those below zero apart, since weights are not negative. At the optimum every entry is 0.
    """
    scored = model.transform(rows).withColumn("_error", vector_to_array("probability")[1] - F.col("label"))
    above, below = F.greatest(F.col("_error"), F.lit(0.0)), F.greatest(-F.col("_error"), F.lit(0.0))
    sums = scored.agg(
        F.count("*").alias("n"),
        F.sum("_error").alias("_total"),
        vector_to_array(Summarizer.sum(F.col("features"), above)).alias("_above"),
        vector_to_array(Summarizer.sum(F.col("features"), below)).alias("_below"),
    )
    penalty = F.array(*[F.lit(regularisation * float(c)) for c in model.coefficients.toArray()])
    loss = F.zip_with("_above", "_below", lambda a, b: a - b)
    entries = F.zip_with(loss, penalty, lambda x, p: x / F.col("n") + p)
    return sums.select("n", F.concat(entries, F.array(F.col("_total") / F.col("n"))).alias("gradient"))


def score_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, n_different): rows scored by either, and those whose scores differ or that one side lacks."""
    key = ["model_name", "split", "id"]
    both = a.select(*key, F.col("y_score").alias("_a")).join(b.select(*key, F.col("y_score").alias("_b")), key, "full")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_different"))


def train_and_score(encoded: DataFrame, registry: list[dict], save_to: str | None = None, most_rows: int | None = None) -> DataFrame:
    """Fit every model on the train split and score all splits into one long table.

    The features are written once: every fit and every scoring pass reads them again.
    ``most_rows`` bounds the labelled rows that a fit sees (by a hash of the id); all rows are scored.
    """
    encoded = materialize(encoded, "features")
    train = encoded.where(F.col("split") == "train")
    if most_rows is not None:
        train = materialize(train.orderBy(F.xxhash64("id"), "id").limit(most_rows), "training-rows")
    scored = []
    for order, (name, estimator) in enumerate(build_models(registry, max(1, train.count()))):
        model = estimator.fit(train)
        if save_to is not None:
            model.write().overwrite().save(f"{save_to}/{name}")
        scored.append(score(model, encoded, name, order))
    return reduce(DataFrame.unionByName, scored)
