"""Small cases with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from evalspark import EvalConfig, SliceRule
from evalspark.operators import decision as D
from evalspark.operators import metrics as M
from evalspark.operators.cells import score_cells, slice_cells
from evalspark.operators.ranking import ranking_metrics
from evalspark.operators.slicing import overall_scores, rule_mask
from evalspark.plans import evaluate as P
from evalspark.sources.predictions import KEYS


def cells_of(preds, cfg):
    sliced = overall_scores(preds)
    return slice_cells(score_cells(sliced.scores, cfg), sliced)


def test_expected_cost_of_four_rows(make):
    preds = make([("m", 0, 0, 0.1), ("m", 1, 0, 0.9), ("m", 2, 1, 0.2), ("m", 3, 1, 0.8)])
    cfg = EvalConfig(costs={"c": {"TP": -1.0, "TN": 0.0, "FP": 2.0, "FN": 5.0}})
    row = D.price(M.confusion(cells_of(preds, cfg)), cfg).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 1, 1, 1)
    assert row.expected_cost == 1.5


def test_binary_metrics_of_four_rows(make):
    preds = make([("m", 0, 0, 0.2), ("m", 1, 1, 0.8), ("m", 2, 0, 0.6), ("m", 3, 1, 0.4)])
    cfg = EvalConfig(ece_bins=5)
    row = M.summary(cells_of(preds, cfg)).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 1, 1, 1)
    assert row.accuracy == 0.5
    assert row.brier == pytest.approx(0.2)
    assert row.ece == pytest.approx(0.5)
    ranked = ranking_metrics(overall_scores(preds).scores, KEYS).first()
    assert ranked.roc_auc == 0.75
    assert ranked.pr_auc == pytest.approx((1 / 1) * 0.5 + (2 / 3) * 0.5)


def test_rule_on_a_table(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "a int, b int")
    mask = [r.m for r in df.orderBy("a").select(rule_mask(df, "a >= 2").alias("m")).collect()]
    assert mask == [False, True, True]
    with pytest.raises(ValueError, match="not boolean"):
        rule_mask(df, "a + b")


def test_grid_has_91_thresholds_equal_to_two_decimals():
    grid = EvalConfig().thresholds
    assert len(grid) == 91
    assert grid == [float(f"0.{i:02d}") for i in range(5, 96)]
    assert EvalConfig(optimize_threshold=False).thresholds == [0.5]


def test_scores_on_edges_fall_where_a_comparison_puts_them(make):
    scores = [0.0, 0.05, 0.3, 0.6, 0.7, 0.95, 1.0, 0.299999, 1.5, -0.2]
    preds = make([("m", i, i % 2, s) for i, s in enumerate(scores)])
    cfg = EvalConfig()
    cells = score_cells(overall_scores(preds).scores, cfg).collect()
    for c in cells:
        s = c.sum_score / c.n
        assert c.grid_bucket == sum(t <= s for t in cfg.thresholds)
        e = cfg.ece_edges
        expected = [i for i in range(10) if e[i] <= s and (s < e[i + 1] or (i == 9 and s <= 1.0))]
        assert c.ece_bin == (expected[0] if expected else None)
    row = M.summary(cells_of(preds, cfg)).first()
    assert row.n == len(scores)  # scores outside [0, 1] are in no bin but count as rows


def test_every_threshold_is_answered_and_matches_a_direct_count(make):
    data = [("m", i, (i * 7) % 3 == 0, ((i * 37) % 101) / 100) for i in range(200)]
    data = [(m, i, int(y), s) for m, i, y, s in data]
    cfg = EvalConfig()
    rows = D.cost_curve(cells_of(make(data), cfg), cfg, ["default"]).collect()
    assert sorted(r.threshold for r in rows) == cfg.thresholds
    for r in rows:
        tp = sum(y == 1 and s >= r.threshold for _, _, y, s in data)
        fp = sum(y == 0 and s >= r.threshold for _, _, y, s in data)
        assert (r.tp, r.fp) == (tp, fp)
        assert r.tp + r.fn + r.tn + r.fp == 200
        assert r.expected_cost == (-1.0 * r.tp + 2.0 * r.fp + 5.0 * r.fn) / 200


def test_ties_go_to_the_lowest_threshold_and_the_first_model(make):
    rows = [("z_first", 0, 1, 0.9), ("z_first", 1, 0, 0.1), ("a_second", 0, 1, 0.9), ("a_second", 1, 0, 0.1)]
    cfg = EvalConfig()
    best = D.best_thresholds(D.cost_curve(cells_of(make(rows), cfg), cfg, ["default"]))
    assert {r.best_threshold for r in best.collect()} == {0.11}
    winner = D.winners(best, ["use_case", "split"]).first()
    assert winner.model_name == "z_first"


def test_operating_threshold_must_be_one_value(make):
    preds = make([("m", 0, 1, 0.4), ("m", 1, 0, 0.2)])
    cfg = EvalConfig()
    own = preds.withColumn("threshold", F.lit(0.3))
    row = M.summary(cells_of(own, cfg), "n_op").first()
    assert (row.threshold, row.tp, row.fn) == (0.3, 1, 0)
    two = preds.withColumn("threshold", F.col("id") / 10.0)
    with pytest.raises(Exception, match="more than one operating threshold"):
        M.summary(cells_of(two, cfg), "n_op").collect()


def test_multiclass_macro_by_hand(spark):
    # class 0: 1 of 2 right; class 1: right once of two guesses; class 2 never true, guessed once
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "label int, y_pred int").withColumn("m", F.lit("x"))
    row = M.multiclass_metrics(df, ["m"]).first()
    assert row.accuracy == 0.5
    assert row.precision_macro == pytest.approx((1.0 + 0.5 + 0.0) / 3)
    assert row.recall_macro == pytest.approx((0.5 + 0.5 + 0.0) / 3)
    assert row.f1_macro == pytest.approx((2 / 3 + 0.5 + 0.0) / 3)


def test_comparison_lists_models_by_cost(make):
    rows = [("bad", i, i % 2, 0.9 if i % 2 == 0 else 0.1) for i in range(10)]
    rows += [("good", i, i % 2, 0.9 if i % 2 else 0.1) for i in range(10)]
    m = P.measure(make(rows), None, EvalConfig())
    ranked = P.compare(m, ["default"]).orderBy("rank").collect()
    assert [r.model_name for r in ranked] == ["good", "bad"]
    assert (ranked[0].roc_auc, ranked[0].pr_auc, ranked[1].roc_auc) == (1.0, 1.0, 0.0)
    advice = P.recommend(m, ["default"]).first()
    assert advice.recommended_model == "good"
    assert [e.model for e in advice.ranking] == ["good", "bad"]


def test_unknown_use_case_is_an_error():
    with pytest.raises(ValueError, match="unknown use case"):
        EvalConfig().costs_of(["nope"])


def test_run_id_depends_on_costs_and_rules():
    base = EvalConfig()
    assert base.run_id() == EvalConfig().run_id()
    assert len(base.run_id()) == 12
    assert base.run_id() != EvalConfig(rules=(SliceRule("r", "a > 1"),)).run_id()
    assert base.run_id() != EvalConfig(costs={"c": {"TP": 0.0, "TN": 0.0, "FP": 1.0, "FN": 1.0}}).run_id()
