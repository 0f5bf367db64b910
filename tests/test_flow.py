"""The whole flow, and what must not change its results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark import EvalConfig, SliceRule
from evalspark.operators import metrics as M
from evalspark.plans import evaluate as P
from evalspark.plans import queries as Q
from evalspark.sources import warehouse as W
from evalspark.sources.sinks import write_reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return W.orders_predictions(spark, SF).cache(), W.orders_examples(spark, SF).cache()


@pytest.fixture(scope="module")
def full(inputs):
    return P.evaluate(*inputs, Q.CONFIG, Q.ALL_COSTS)


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_every_report_has_rows(full):
    for name, df in full.tables().items():
        if name not in ("rejected", "unmatched"):  # empty in a sound data set
            assert df.take(1), name
    assert full.rejected.count() == full.unmatched.count() == 0
    assert [(r.slice_name, r.reason) for r in full.skipped_rules.collect()] == [("web", "missing column")]
    errors = full.errors.groupBy("model_name", "split", "use_case", "error_type").count()
    assert errors.agg(F.max("count")).first()[0] <= 25
    assert full.errors.where("text is null").count() == 0


def test_curve_at_one_half_is_the_confusion_at_one_half(full, inputs):
    m = P.measure(inputs[0], None, Q.CONFIG, with_ranking=False)
    half = table(M.confusion(m.cells, "n_half"), "model_name", "split")
    for r in full.cost_curve.where("threshold = 0.5 and use_case = 'default'").collect():
        assert (r.tn, r.fp, r.fn, r.tp) == tuple(half[(r.model_name, r.split)][c] for c in ("tn", "fp", "fn", "tp"))


def test_order_and_partitions_do_not_matter(full, inputs):
    preds, examples = inputs
    other = P.evaluate(preds.orderBy(F.rand(5)).repartition(5), examples.repartition(3), Q.CONFIG, ["default"])
    a = table(full.slices.where("use_case = 'default'"), "model_name", "split", "slice_name")
    b = table(other.slices, "model_name", "split", "slice_name")
    assert a.keys() == b.keys()
    for k in a:
        for c in ("n", "tp", "best_threshold", "expected_cost"):
            assert a[k][c] == b[k][c]
        for c in ("brier", "ece", "roc_auc", "pr_auc", "avg_confidence"):
            assert a[k][c] == (pytest.approx(b[k][c], abs=1e-12) if b[k][c] is not None else None)


def test_every_row_twice_leaves_the_ratios(inputs):
    preds, _ = inputs
    once = table(P.compare(P.measure(preds, None, Q.CONFIG)), "model_name", "split", "use_case")
    copies = preds.union(preds.withColumn("id", F.col("id") + 10_000_000))
    twice = table(P.compare(P.measure(copies, None, Q.CONFIG)), "model_name", "split", "use_case")
    for k, r in once.items():
        assert twice[k].n == 2 * r.n
        for c in ("best_threshold", "expected_cost", "f1_at_best", "roc_auc", "pr_auc", "brier", "ece"):
            assert twice[k][c] == pytest.approx(r[c], abs=1e-12)


def test_per_slice_choice_is_the_cheapest_model(full):
    rows = full.slices.collect()
    for r in full.per_slice.collect():
        mine = [s for s in rows if (s.split, s.slice_name, s.use_case) == (r.split, r.slice_name, r.use_case)]
        assert r.expected_cost == min(s.expected_cost for s in mine)


def test_other_label_and_column_names(inputs):
    preds, examples = inputs
    cfg = EvalConfig(rules=(SliceRule("pos", "label == 1"),), positive_label=9, label_col="target", id_col="key")
    renamed = preds.withColumn("target", F.when(F.col("label") == 1, 9).otherwise(4)).drop("label")
    got = P.evaluate(
        renamed.withColumnRenamed("id", "key"), examples.withColumnRenamed("id", "key").drop("label"), cfg, splits=["test"]
    )
    want = P.measure(preds.where("split = 'test'"), None, Q.CONFIG)
    a, b = table(got.comparison, "model_name"), table(P.compare(want, ["default"]), "model_name")
    assert a.keys() == b.keys()
    assert all(a[k].expected_cost == b[k].expected_cost for k in a)


def test_reports_are_written_per_run(spark, full, tmp_path):
    tables = {"comparison": full.comparison, "recommendation": full.recommendation}
    for fmt in ("json", "parquet"):
        write_reports(tables, str(tmp_path / fmt), full.run_id, fmt)
        write_reports(tables, str(tmp_path / fmt), "other", fmt)
        write_reports(tables, str(tmp_path / fmt), full.run_id, fmt)
        back = spark.read.format(fmt).load(str(tmp_path / fmt / "comparison"))
        assert back.where(F.col("run_id") == full.run_id).count() == full.comparison.count()
        assert back.select("run_id").distinct().count() == 2
    write_reports({"comparison": full.comparison}, str(tmp_path / "csv"), full.run_id, "csv")
    assert spark.read.csv(str(tmp_path / "csv" / "comparison"), header=True).count() == full.comparison.count()
    write_reports({"recommendation": full.recommendation}, str(tmp_path / "csv"), full.run_id, "csv")
    (line,) = spark.read.option("escape", '"').csv(str(tmp_path / "csv" / "recommendation"), header=True).limit(1).collect()
    assert json.loads(line.ranking)[0]["rank"] == 1
    with pytest.raises(ValueError):
        write_reports(tables, str(tmp_path), full.run_id, "xml")


def test_top_errors_are_limited_before_the_shuffle(spark):
    from evalspark.operators import errors as E

    preds = W.orders_predictions(spark, SF)
    best = P.measure(preds, None, Q.CONFIG, with_ranking=False).best(["default"])
    df = E.top_errors(E.errors_at_best(preds, best), 25)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["cost_curve", "slice_costs", "slice_recommendation", "error_counts", "exact_split",
                                  "winner_by_use_case", "label_frequency", "difficulty_disagreement"])
def test_no_product_of_rows(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = Q.QUERIES["cost_curve"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_slices_and_their_thresholds_can_be_left_out(inputs):
    plain = P.evaluate(*inputs, EvalConfig(per_slice=False))
    assert plain.slices is None and plain.per_slice is None
    assert plain.comparison.count() == 6
    m = P.measure(*inputs, EvalConfig(per_slice_thresholds=False, auto_slices=False, rules=Q.RULES[:1]), with_ranking=False)
    assert "best_threshold" not in P.slice_table(m).columns


def test_all_errors_carry_their_texts(full):
    counts = table(full.all_errors.groupBy("model_name", "split", "use_case").agg(F.count("text").alias("n")),
                   "model_name", "split", "use_case")
    for r in full.error_status.collect():
        if r.error_count:
            assert counts[(r.model_name, r.split, r.use_case)].n == r.error_count


def test_intermediate_tables_go_to_the_named_folder(spark, full):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"), "evalspark", spark.sparkContext.applicationId)
    assert any(p.name.startswith("cells-") for p in folder.iterdir())


def test_intermediate_tables_are_in_one_folder(spark):
    from evalspark import storage

    folder = storage.shared_dir(spark)
    written = storage.materialize(spark.range(3), "three")
    assert written.count() == 3 and written.inputFiles()[0].removeprefix("file://").startswith(folder.removeprefix("file://"))
