"""ROC AUC and average precision against brute force, however the scores are spread."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators.ranking import ranking_metrics, score_ranges
from evalspark.operators.slicing import overall_scores
from evalspark.sources.predictions import KEYS


def brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None, None
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted(set(pos)):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap += pos.count(t) / len(pos) * tp / (tp + fp)
    return auc, ap


def spread(kind, n, rng):
    if kind == "continuous":
        return [rng.random() for _ in range(n)]
    if kind == "tied":
        return [rng.randrange(8) / 8 for _ in range(n)]
    if kind == "crowded":  # most scores within a tiny range
        return [rng.random() * 1e-6 if rng.random() < 0.9 else rng.random() for _ in range(n)]
    if kind == "one value":
        return [0.25] * n
    return [0.0 if rng.random() < 0.4 else rng.random() for _ in range(n)]  # a third and more on one score


@pytest.mark.parametrize("kind", ["continuous", "tied", "crowded", "one value", "hot"])
def test_against_pair_counts(make, kind):
    rng = random.Random(7)
    scores = spread(kind, 300, rng)
    rows = [("m", i, int(rng.random() < 0.3 + 0.4 * (s > 0.3)), s) for i, s in enumerate(scores)]
    auc, ap = brute([(y, s) for _, _, y, s in rows])
    preds = overall_scores(make(rows)).scores
    for edges in (None, [], [0.1, 0.2, 0.25, 0.9], score_ranges(preds, 50)):
        got = ranking_metrics(preds, KEYS, edges=edges).first()
        assert got.roc_auc == pytest.approx(auc, abs=1e-12)
        assert got.pr_auc == pytest.approx(ap, abs=1e-12)


def test_one_class_gives_null(make):
    got = ranking_metrics(overall_scores(make([("m", 0, 1, 0.2), ("m", 1, 1, 0.7)])).scores, KEYS).first()
    assert got.roc_auc is None and got.pr_auc is None


def test_overlapping_slices_and_weights(make):
    rng = random.Random(3)
    rows = [("m", i, int(rng.random() < 0.5), rng.randrange(20) / 20) for i in range(120)]
    ids = F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))
    preds = make(rows).withColumn("slice_ids", ids)
    got = {r.slice_id: r for r in ranking_metrics(preds, KEYS).collect()}
    for slice_id, keep in ((0, lambda i: True), (1, lambda i: i % 3 == 0), (2, lambda i: i % 3 != 0)):
        auc, ap = brute([(y, s) for _, i, y, s in rows if keep(i)])
        assert got[slice_id].roc_auc == pytest.approx(auc)
        assert got[slice_id].pr_auc == pytest.approx(ap)
    tripled = ranking_metrics(preds.withColumn("weight", F.lit(3)), KEYS).collect()
    for r in tripled:
        assert r.roc_auc == pytest.approx(got[r.slice_id].roc_auc)


def test_both_sides_of_the_plan_share_one_shuffle(spark, make, tmp_path):
    rows = [("m", i, i % 2, (i * 17 % 50) / 50) for i in range(200)]
    overall_scores(make(rows)).scores.write.parquet(str(tmp_path / "s"))
    df = ranking_metrics(spark.read.parquet(str(tmp_path / "s")), KEYS)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert plan.split("== Initial Plan ==")[0].count("FileScan") == 1


@pytest.mark.parametrize("kind", ["continuous", "tied", "crowded", "one value", "hot"])
def test_ranges_are_of_like_size(make, kind):
    rng = random.Random(11)
    scores = spread(kind, 2000, rng)
    preds = make([("m", i, i % 2, s) for i, s in enumerate(scores)])
    edges = score_ranges(preds, 8)
    most = max(scores.count(s) for s in set(scores))
    cuts = [-1.0, *edges, 9.0]
    sizes = [sum(a <= s < b for s in scores) for a, b in zip(cuts, cuts[1:])]
    assert sum(sizes) == 2000 and max(sizes) <= max(2000 // 8 + 2000 // 16, most + 2000 // 8)


def test_no_sketch_of_all_scores_in_one_task(spark, make, tmp_path):
    df = ranking_metrics(overall_scores(make([("m", i, i % 2, i / 100) for i in range(100)])).scores, KEYS)
    assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()
