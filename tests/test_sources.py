"""Reading, hygiene, splits, features, models and storage of predictions."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evalspark import EvalConfig, SliceRule
from evalspark.operators import features as X
from evalspark.operators import models
from evalspark.operators.splits import exact_split, hash_split
from evalspark.plans.refusals import refused_inputs
from evalspark.sources import examples as ex
from evalspark.sources import predictions as pr
from evalspark.sources import warehouse as W

SF = "/root/testdata/sf0.001"


def test_csv_load_drops_copies_and_rows_without_a_label(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('x,label,text\n1,1,"a, ""b"""\n1,1,"a, ""b"""\n2,,c\n3,0.9,d\n')
    rows = ex.load(spark, ex.csv_loader(str(path), multi_line=True)).collect()
    assert {(r.x, r.label, r.text) for r in rows} == {(1, 1, 'a, "b"'), (3, 0, "d")}
    assert len({r.id for r in rows}) == 2
    with_schema = ex.load(spark, ex.csv_loader(str(path), "x int, label double, text string", True))
    assert {r.id for r in with_schema.collect()} == {r.id for r in rows}


def test_missing_label_column_is_an_error(spark):
    with pytest.raises(ValueError, match="no label column"):
        ex.clean_examples(spark.range(3))


def test_content_id_ignores_position(spark):
    df = W.table(spark, SF, "lineitem")
    a = {r.id for r in ex.content_id(df).select("id").collect()}
    b = {r.id for r in ex.content_id(df.orderBy(F.rand())).select("id").collect()}
    assert a == b


@pytest.mark.parametrize("cells", [1, 7, 4096])
def test_exact_split_has_exact_sizes_per_label(spark, cells):
    df = W.orders_scores(spark, SF).select("id", "label")
    got = exact_split(df, cells=cells)
    assert got.count() == df.count()
    for label in (0, 1):
        n = df.where(F.col("label") == label).count()
        sizes = {r.split: r["count"] for r in got.where(F.col("label") == label).groupBy("split").count().collect()}
        assert sizes["test"] == round(n * 0.2) and sizes["val"] == round(n * 0.1)
    again = exact_split(df.orderBy(F.desc("id")).repartition(3), cells=cells)
    assert got.exceptAll(again).count() == 0


def test_exact_split_of_a_tiny_label(spark):
    df = spark.createDataFrame([(i, 0) for i in range(20)] + [(99, 1)], "id bigint, label int")
    got = exact_split(df)
    assert got.count() == 21
    assert got.where("id = 99").first().split == "train"


def test_hash_split_is_stable_when_rows_are_added(spark):
    few = {r.id: r.s for r in spark.range(100).select("id", hash_split(F.col("id")).alias("s")).collect()}
    many = {r.id: r.s for r in spark.range(5000).select("id", hash_split(F.col("id")).alias("s")).collect()}
    assert all(many[i] == s for i, s in few.items())
    share = sum(s == "test" for s in many.values()) / 5000
    assert 0.18 < share < 0.22


def test_predictions_are_stored_and_pruned_by_folder(spark, tmp_path):
    preds, path = W.orders_predictions(spark, SF), str(tmp_path / "p")
    pr.save_predictions(preds, path, "run1")
    pr.save_predictions(preds, path, "run2")
    pr.save_predictions(preds.where("model_name = 'model_a' and split = 'val'").withColumn("y_score", F.lit(0.0)), path, "run1")
    back = pr.load_predictions(spark, path, "run1", ["model_a"], ["val"])
    assert back.agg(F.max("y_score")).first()[0] == 0.0
    assert pr.load_predictions(spark, path, "run1").count() == preds.count()
    assert pr.load_predictions(spark, path, "run2", ["model_a"], ["val"]).agg(F.max("y_score")).first()[0] > 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_names_that_look_like_numbers_stay_names(spark, make, tmp_path):
    path = str(tmp_path / "named")
    pr.save_predictions(make([("01", 0, 1, 0.5), ("02", 0, 1, 0.6)]), path, "000123456789")
    back = pr.load_predictions(spark, path, "000123456789", ["01"], ["test"]).collect()
    assert [(r.run_id, r.model_name, r.split, r.y_score) for r in back] == [("000123456789", "01", "test", 0.5)]


def test_one_hot_covers_all_splits_and_leaves_nulls_at_zero(spark):
    df = spark.createDataFrame(
        [(1, 0, "train", "EU", 1.0), (2, 1, "test", "US", 2.0), (3, 1, "val", None, 3.0)],
        "id bigint, label int, split string, region string, amount double",
    )
    levels = X.category_levels(df, ["region"])
    assert levels == {"region": ["EU", "US"]}
    wide = {r.id: (r.region_EU, r.region_US) for r in X.one_hot(df, levels).collect()}
    assert wide == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    assert X.encode(df).columns == ["id", "label", "split", "features"]
    assert X.feature_columns(df) == ["region", "amount"]


def test_text_among_the_features_is_an_error(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="non-numeric"):
        X.assemble(df, ["a", "b"])


def test_any_number_of_levels_is_encoded_sparsely(spark):
    df = spark.range(30000).select("id", F.lit(1).alias("label"), F.col("id").cast("string").alias("c"))
    got = X.encode(df.unionAll(spark.createDataFrame([(30000, 0, None)], "id bigint, label int, c string"))).where("id in (7, 30000)").collect()
    assert {r.id: (r.features.size, r.features.numNonzeros()) for r in got} == {7: (30000, 1), 30000: (30000, 0)}


def test_registry():
    entries = [{"name": "a", "type": "logistic_regression"}, {"name": "b", "type": "boosted_trees", "enabled": False},
               {"name": "c", "type": "random_forest", "params": {"max_depth": None}}]
    built = models.build_models(entries, 100)
    assert [n for n, _ in built] == ["a", "c"]
    assert built[0][1].getRegParam() == pytest.approx(0.01)
    assert built[1][1].getMaxDepth() == 30
    with pytest.raises(ValueError, match="unknown model type"):
        models.build_models([{"name": "x", "type": "magic"}], 1)


def test_train_score_save_and_load(spark, tmp_path):
    encoded = X.encode(W.orders_examples(spark, SF)).cache()
    registry = [
        {"name": "lr", "type": "logistic_regression", "params": {"C": 1.0, "max_iter": 20}},
        {"name": "rf", "type": "random_forest", "params": {"n_estimators": 5, "max_depth": 4}},
        {"name": "gbt", "type": "boosted_trees", "params": {"n_estimators": 3, "max_depth": 3, "colsample_bytree": 0.8}},
    ]
    first = models.train_and_score(encoded, registry, str(tmp_path)).cache()
    assert first.where(~F.col("y_score").between(0, 1)).count() == 0
    assert first.count() == 3 * encoded.count()
    assert {(r.model_name, r.model_order) for r in first.select("model_name", "model_order").distinct().collect()} == {
        ("lr", 0), ("rf", 1), ("gbt", 2)}
    loaded = models.load_model("random_forest", str(tmp_path / "rf"))
    again = models.score(loaded, encoded, "rf", 1)
    assert first.where("model_name = 'rf'").exceptAll(again).count() == 0


def test_registered_boosted_trees_have_every_round(spark):
    from evalspark.operators.models import build_models
    from evalspark.plans.queries import REGISTRY

    fits = dict(build_models(REGISTRY, 1000))
    assert fits["xgb"].getMaxIter() == 400 and fits["xgb"].getStepSize() == 0.05 and fits["xgb"].getMaxDepth() == 6


def test_gradient_is_that_of_the_penalised_loss(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, "train", int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))], ["id", "split", "label", "features"])
    (_, estimator), = models.build_models([{"name": "a", "type": "logistic_regression", "params": {"C": 0.05, "max_iter": 200}}], 200)
    for iterations in (1, 200):
        fitted = estimator.copy({estimator.maxIter: iterations}).fit(df)
        w, b = fitted.coefficients.toArray(), fitted.intercept
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        want = np.r_[x.T @ error / 200 + estimator.getRegParam() * w, error.mean()]
        got = models.logistic_gradient(fitted, df, estimator.getRegParam()).first()
        assert got.n == 200 and np.allclose(got.gradient, want, atol=1e-12)
        assert (np.abs(got.gradient).max() < 1e-5) == (iterations == 200)


def test_different_scores_are_counted(spark):
    a = spark.createDataFrame([("m", "s", 1, 0.5), ("m", "s", 2, 0.5), ("m", "s", 3, None)], "model_name string, split string, id int, y_score double")
    b = spark.createDataFrame([("m", "s", 1, 0.5), ("m", "s", 2, 0.6), ("m", "s", 3, None), ("m", "s", 4, 0.1)], a.schema)
    assert tuple(models.score_differences(a, b).first()) == (4, 2)


def test_refused_inputs_are_listed_without_reading_rows(spark):
    df = spark.createDataFrame([], "id int, label int, text string, c string, x double, d date, b boolean, `odd name` array<int>")
    rules = (SliceRule("fine", "x > 1 and c in ('a b', 'nope')"), SliceRule("gone", "nope == 1"), SliceRule("number", "x + 1"), SliceRule("broken", "x >"), SliceRule("type", "x > d"))
    got = {tuple(r) for r in refused_inputs(df, EvalConfig(rules=rules)).collect()}
    assert got == {("rule", "gone", "nope", "missing_column"), ("rule", "number", None, "not_boolean"), ("rule", "broken", None, "unreadable"), ("rule", "type", None, "unreadable"),
                   ("column", "d", "d", "not_numeric"), ("column", "odd name", "odd name", "not_numeric")}
    assert ("column", "label", "label", "missing_label") in {tuple(r) for r in refused_inputs(df.drop("label"), EvalConfig()).collect()}
    assert refused_inputs(df.drop("d", "odd name"), EvalConfig()).count() == 0
