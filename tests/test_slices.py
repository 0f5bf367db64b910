"""Slices: overlap, nulls, missing columns, difficulty, label frequency."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark import EvalConfig, SliceRule
from evalspark.plans.evaluate import measure
from evalspark.operators.slicing import assign_slices, models_disagree
from evalspark.plans import evaluate as P
from evalspark.sources import predictions as pr
from evalspark.sources.sinks import save_bucketed


def rules(*pairs):
    return tuple(SliceRule(n, p) for n, p in pairs)


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(
        [
            (0, "test", 0, "a" * 29, "US", 10.0),
            (1, "test", 1, "a" * 30, "US", 2000.0),
            (2, "test", 1, None, None, None),
            (3, "test", 0, "é" * 80, "EU", 1000.0),
        ],
        "id bigint, split string, label int, text string, region string, amount double",
    )


@pytest.fixture(scope="module")
def preds(make):
    a = [("a", 0, 0, 0.2), ("a", 1, 1, 0.9), ("a", 2, 1, 0.5), ("a", 3, 0, 0.36)]
    b = [("b", 0, 0, 0.6), ("b", 1, 1, 0.8), ("b", 2, 1, 0.7), ("b", 3, 0, 0.1)]
    return make(a + b)


def members(preds, examples, cfg):
    m = P.measure(preds, examples, cfg, with_ranking=False)
    sizes = P.slice_sizes(m).collect()
    return {(r.model_name, r.slice_name): r.n for r in sizes}, m


def test_rule_nulls_are_outside_and_missing_columns_are_skipped(preds, examples):
    cfg = EvalConfig(
        rules=rules(
            ("not_us", "region != 'US'"), ("small", "not (amount >= 1000)"), ("pos", "label == 1"),
            ("both", "label == 1 and amount > 1"), ("web", "channel == 'web' and amount > 0"), ("none", "amount > 1e9"),
            ("scored", "y_score >= 0.6"), ("words", "region in ('two words', 'EU')"),
        )
    )
    found, m = members(preds, examples, cfg)
    assert found[("a", "not_us")] == 1
    assert found[("a", "small")] == 1
    assert found[("a", "pos")] == 2
    assert found[("a", "both")] == 1
    assert found[("a", "scored")] == 1 and found[("b", "scored")] == 3
    assert found[("a", "words")] == 1
    assert ("a", "none") not in found  # an empty slice does not appear
    assert [rule.name for rule, _ in m.skipped] == ["web"]


def test_text_length_counts_characters_and_null_is_empty(preds, examples):
    found, _ = members(preds, examples, EvalConfig())
    assert found[("a", "text_len[0,30)")] == 2
    assert found[("a", "text_len[30,80)")] == 1
    assert found[("a", "text_len[80,160)")] == 1
    assert ("a", "text_len[160,1000000)") not in found


def test_confidence_and_label_frequency(preds, examples):
    found, _ = members(preds, examples, EvalConfig())
    assert ("a", "confidence[0.0,0.5)") not in found
    assert found[("a", "confidence[0.5,0.7)")] == 2
    assert found[("a", "confidence[0.7,0.85)")] == 1
    assert found[("a", "confidence[0.85,1.01)")] == 1
    assert found[("a", "label_freq[0.2,1.01)")] == 4


def test_difficulty_is_disagreement_or_uncertainty(preds, examples):
    found, _ = members(preds, examples, EvalConfig())
    assert found[("a", "hard_examples")] == found[("b", "hard_examples")] == 1
    alone, _ = members(preds.where("model_name = 'a'"), examples, EvalConfig())
    assert alone[("a", "hard_examples")] == 2  # 0.5 and 0.36
    same_id = Window.partitionBy("id", "split")
    hard = {r.id: r.hard for r in preds.withColumn("hard", models_disagree(same_id, F.col("y_score"))).collect()}
    assert hard == {0: True, 1: False, 2: False, 3: False}


def test_uncertainty_margin_is_open(make, examples):
    preds = make([("a", 0, 0, 0.35), ("a", 1, 1, 0.65), ("a", 2, 1, 0.36), ("a", 3, 0, 0.64)])
    found, _ = members(preds, examples, EvalConfig())
    assert found[("a", "hard_examples")] == 2


def test_automatic_slices_can_be_switched_off(preds, examples):
    found, _ = members(preds, examples, EvalConfig(auto_slices=False, rules=rules(("pos", "label == 1"))))
    assert {s for _, s in found} == {"__all__", "pos"}
    found, _ = members(preds, examples, EvalConfig(difficulty=False))
    assert not any("examples" in s for _, s in found)
    found, _ = members(preds, examples.drop("text"), EvalConfig())
    assert not any(s.startswith("text_len") for _, s in found)


def test_rule_errors_other_than_a_missing_column_are_raised(preds, examples):
    with pytest.raises(ValueError, match="not boolean"):
        assign_slices(preds, examples, EvalConfig(rules=rules(("bad", "amount + 1"))))
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        assign_slices(preds, examples, EvalConfig(rules=rules(("bad", "amount >>> < 1"))))


def test_label_of_the_prediction_counts(preds, examples):
    wrong = examples.withColumn("label", F.lit(7))
    found, _ = members(preds, wrong, EvalConfig(rules=rules(("pos", "label == 1"))))
    assert found[("a", "pos")] == 2


def test_repeated_ids_are_an_error(preds, examples):
    twice = preds.union(preds.where("id = 1 and model_name = 'a'"))
    with pytest.raises(Exception, match="duplicate prediction of id 1"):
        members(twice, examples, EvalConfig())
    with pytest.raises(ValueError, match="duplicate prediction"):
        pr.require_unique_ids(twice)
    pr.require_unique_ids(preds)


def test_unscorable_rows_are_set_aside_with_a_reason(spark, preds):
    bad = spark.createDataFrame(
        [("a", 0, "test", 10, None, 0.1), ("a", 0, "test", 11, 3, 0.1), ("a", 0, "test", 12, 1, None),
         ("a", 0, "test", 13, 1, float("nan"))],
        preds.schema,
    )
    both = preds.union(bad)
    assert pr.valid_predictions(both).count() == preds.count()
    reasons = {r.id: r.reject_reason for r in pr.rejected_predictions(both).collect()}
    assert reasons == {10: "label_missing", 11: "label_not_binary", 12: "score_missing", 13: "score_not_a_number"}


def test_unmatched_predictions(preds, examples):
    left = pr.unmatched_predictions(preds, examples.where("id <> 2"))
    assert {(r.model_name, r.id) for r in left.collect()} == {("a", 2), ("b", 2)}


def test_single_class_slice_has_no_auc(preds, examples):
    m = P.measure(preds, examples, EvalConfig(rules=rules(("pos", "label == 1"))))
    rows = {(r.model_name, r.slice_name): r for r in P.slice_table(m, ["default"]).collect()}
    assert rows[("a", "pos")].roc_auc is None and rows[("a", "pos")].pr_auc is None
    assert rows[("a", "text_len[0,30)")].roc_auc == 1.0
    assert rows[("a", "pos")].unstable and rows[("a", "pos")].reason == "low_sample_count"


def test_texts_do_not_travel_through_the_join(preds, examples, spark, tmp_path):
    examples.write.parquet(str(tmp_path / "e"))
    preds.write.parquet(str(tmp_path / "p"))
    s = assign_slices(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "e")), EvalConfig())
    plan = s.scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2
    project = s.scores._jdf.queryExecution().optimizedPlan().toString()
    join = project[project.index("Join"):]
    example_side = [line for line in join.splitlines() if "_early" in line][0]
    assert " text#" not in example_side.split("AS _early")[-1]


def test_bucketed_tables_are_joined_without_a_shuffle(preds, examples, spark):
    save_bucketed(preds, "bucketed_preds", 4)
    save_bucketed(examples, "bucketed_examples", 4)
    s = assign_slices(spark.table("bucketed_preds"), spark.table("bucketed_examples"), EvalConfig())
    plan = s.scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert s.scores.count() == preds.count()


def test_scored_rows_without_an_example_stay(make, examples, spark):
    """With and without slices the same rows are measured."""
    preds = make([("a", i, i % 2, i / 10) for i in range(10)])
    few = examples.where("id < 3")
    for per_slice in (few, None):
        m = measure(preds, per_slice, EvalConfig(), with_ranking=False)
        assert {r.n for r in m.summary().where("slice_id = 0").collect()} == {10}
    sliced = assign_slices(preds, few, EvalConfig())
    names = {r.id: {sliced.slices[i].name.split("[")[0] for i in r.slice_ids} for r in sliced.scores.collect()}
    assert all("confidence" in n for n in names.values())
    assert {i for i, n in names.items() if "text_len" in n} == {0, 1, 2}


def test_a_repeated_example_is_an_error(make, examples):
    preds = make([("a", i, i % 2, i / 10) for i in range(4)])
    with pytest.raises(Exception, match="duplicate example"):
        assign_slices(preds, examples.unionAll(examples), EvalConfig()).scores.collect()


def test_one_id_in_two_splits(make, examples):
    """Examples without a split: each split has its own votes, and no score counts as scored twice."""
    rows = [("a", 0, 1, 0.9), ("a", 1, 0, 0.1), ("b", 0, 1, 0.8), ("b", 1, 0, 0.2)]
    other = [("a", 0, 1, 0.9), ("a", 1, 0, 0.1), ("b", 0, 1, 0.1), ("b", 1, 0, 0.2)]
    preds = make(rows).unionAll(make(other, "val"))
    sliced = assign_slices(preds, examples.drop("split"), EvalConfig())
    hard = [s.name for s in sliced.slices].index("hard_examples")
    got = {(r.model_name, r.split, r.id) for r in sliced.scores.collect() if hard in r.slice_ids}
    assert got == {("a", "val", 0), ("b", "val", 0)}
