"""Error texts, clusters and bootstrap intervals: invariants and small brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark import EvalConfig
from evalspark.operators import errors as E
from evalspark.functions import draws as R
from evalspark.operators import instability as I
from evalspark.operators import text as T
from evalspark.plans import evaluate as P
from evalspark.plans import queries as Q
from evalspark.plans.error_clusters import error_clusters
from evalspark.sources import warehouse as W
from evalspark.sources.predictions import KEYS

SF = "/root/testdata/sf0.001"


def test_tokens_are_words_then_pairs_without_stop_words(spark):
    df = spark.createDataFrame([("The quick-brown fox, a 2x X_1 é été",), (None,), ("one",)], "t string")
    got = [r.k for r in df.select(T.tokens(F.col("t")).alias("k")).collect()]
    words = ["quick", "brown", "fox", "2x", "x_1", "été"]
    assert got[0] == words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    assert got[1] == [] and got[2] == ["one"]
    plain = df.select(T.words(F.col("t"), [])).first()[0]
    assert plain[0] == "the"


def test_error_terms_against_a_direct_count(spark):
    rows = [("m", 0, "s", "u", "FP", f"late parcel box{i % 3}") for i in range(9)]
    rows += [("m", 0, "s", "u", "FN", "broken box1 broken")]
    df = spark.createDataFrame(rows, "model_name string, model_order int, split string, use_case string, error_type string, text string")
    got = {(r.error_type, r.term): (r.rank, r.n_errors) for r in E.error_terms(df, 10).collect()}
    assert got[("FP", "late")] == (1, 9) and got[("FP", "late parcel")] == (2, 9) and got[("FP", "parcel")] == (3, 9)
    assert got[("FP", "box0")][1] == 3
    assert got[("FN", "broken")][1] == 1  # once per error, however often it occurs


def test_cluster_status_without_text_and_with_few_errors(spark):
    best = spark.createDataFrame([("m", 0, "s", "u", 3, 4), ("n", 1, "s", "u", 30, 4)],
                                 "model_name string, model_order int, split string, use_case string, fp bigint, fn bigint")
    got = {r.model_name: (r.available, r.reason, r.error_count) for r in E.cluster_status(best, True, 20).collect()}
    assert got == {"m": (False, "too_few_errors", 7), "n": (True, None, 34)}
    assert {r.reason for r in E.cluster_status(best, False, 20).collect()} == {"no_text_column"}


def test_number_of_clusters():
    assert [T.cluster_count(n, 6) for n in (20, 60, 200, 10_000)] == [3, 5, 6, 6]


def test_tfidf_is_smoothed_and_of_length_one(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"])], "id int, tokens array<string>")
    rows, vocabulary = T.tfidf(docs, 5000)
    raw = rows.where("id = 1").select(F.unwrap_udt("tfidf").alias("v")).first().v
    got = dict(zip((vocabulary[i] for i in raw["indices"]), raw["values"]))
    a, b = 2 * (np.log(3 / 3) + 1), np.log(3 / 2) + 1
    assert got["a"] == pytest.approx(a / np.hypot(a, b)) and got["b"] == pytest.approx(b / np.hypot(a, b))


def test_latent_basis_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [f"t{int(x)}" for x in rng.zipf(1.6, 30) if x < 40]) for i in range(80)]
    rows, vocabulary = T.tfidf(spark.createDataFrame(docs, "id int, tokens array<string>"), 5000)
    x = np.zeros((80, len(vocabulary)))
    for r in rows.select("id", F.unwrap_udt("tfidf").alias("v")).collect():
        x[r.id, r.v["indices"]] = r.v["values"]
    basis = T.latent_basis(rows, 5)
    exact = np.linalg.svd(x, full_matrices=False)[2][:5]
    assert np.linalg.norm(x @ basis) == pytest.approx(np.linalg.norm(x @ exact.T), rel=1e-4)
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-8)


def test_rows_of_the_matrix_are_the_vectors_of_the_clusters(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "m" if i % 2 else "o", [f"t{int(x)}" for x in rng.zipf(1.6, 30) if x < 40]) for i in range(80)] + [(90, "m", []), (91, "m", ["t1"])]
    df = spark.createDataFrame(docs, "id int, model string, tokens array<string>")
    rows = {(r.model, r.id, r.term): r.weight for r in T.tfidf_rows(df, ["model"], 25).collect()}
    for model in "mo":
        vectors, terms = T.tfidf(df.where(F.col("model") == model), 25)
        assert len(terms) == 25
        own = {(model, r.id, terms[i]): w for r in vectors.select("id", F.unwrap_udt("tfidf").alias("v")).collect() for i, w in zip(r.v["indices"], r.v["values"])}
        assert own.keys() == {k for k in rows if k[0] == model}
        assert all(rows[k] == pytest.approx(w, rel=1e-12) for k, w in own.items())


def test_texts_are_parsed_once_and_only_those_of_the_errors(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        parsed.add(1)
        return text.split()

    texts = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3} a") for i in range(100)], "id int, text string")
    wrong = spark.createDataFrame([("m", i) for i in range(0, 40, 2)], "model string, id int")
    docs = wrong.join(texts, "id").withColumn("tokens", counted("text"))
    assert T.tfidf_rows(docs, ["model"], 25).count() == 60 and parsed.value == 20


def test_terms_are_ranked_in_parts(spark):
    docs = spark.createDataFrame([(i, "m", [f"t{i}", f"t{i + 1}", "a"]) for i in range(300)], "id int, model string, tokens array<string>")
    got = T.tfidf_rows(docs, ["model"], 7)
    assert {r.term for r in got.select("term").distinct().collect()} == {"a", "t1", "t10", "t100", "t101", "t102", "t103"}
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()  # no task sorts all terms of a group


def _errors(spark, n=60):
    words = ["late", "parcel", "glass", "broken", "refund", "again", "colour", "wrong"]
    rng = np.random.default_rng(5)
    rows = [("m", 0, "s", "u", i, "FP", 0.5, " ".join(rng.choice(words, 12))) for i in range(n)]
    return spark.createDataFrame(rows, "model_name string, model_order int, split string, use_case string, id bigint, error_type string, y_score double, text string")


def test_the_latent_space_keeps_what_singular_values_say(spark):
    found = T.cluster_texts(_errors(spark), 60, EvalConfig(max_dimensions=4))
    kept = T.energy(found.rows).first()
    x = np.zeros((60, len(found.terms)))
    for r in found.rows.select("id", F.unwrap_udt("tfidf").alias("v")).collect():
        x[r.id, r.v["indices"]] = r.v["values"]
    residual = ((x - x @ found.basis @ found.basis.T) ** 2).sum()
    assert kept.n == 60 and kept.total == pytest.approx((x**2).sum()) and kept.captured + residual == pytest.approx(kept.total)
    assert kept.per_dimension == pytest.approx(list(found.values**2))


def test_errors_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    dealt = []
    write = T.materialize

    def recorded(df, name):
        dealt.append((name, df.rdd.getNumPartitions()))
        return write(df, name)

    monkeypatch.setattr(T, "materialize", recorded)
    assert T.cluster_texts(_errors(spark, 6_000), 6_000, EvalConfig()) is not None
    assert dealt[0] == ("error-tokens", 2)


def test_the_latent_space_reads_the_vectors_once(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT

    read = spark.sparkContext.accumulator(0)

    @F.udf(VectorUDT())
    def vector(i):
        read.add(1)
        return Vectors.sparse(150, sorted({i % 150, 7 * i % 150, 11 * i % 150}), [1.0] * len({i % 150, 7 * i % 150, 11 * i % 150}))

    basis, values = T.latent_space(spark.range(400).select(vector("id").alias("tfidf")), 5)
    assert basis.shape == (150, 5) and len(values) == 5 and read.value <= 800  # every step of the search read them all before


def test_a_row_in_a_wrong_cluster_is_seen(spark):
    found = T.cluster_texts(_errors(spark), 60, EvalConfig())
    assert sum(r.n_misplaced for r in T.misplaced(found).collect()) == 0
    found.rows = found.rows.withColumn("cluster", F.when(F.col("id") == 7, (F.col("cluster") + 1) % len(found.centers)).otherwise(F.col("cluster")))
    assert sum(r.n_misplaced for r in T.misplaced(found).collect()) == 1


def test_clusters_add_up_to_the_errors(spark):
    rows = [("m", 0, "s", "u", i, "FP" if i % 2 else "FN", 0.5, ["late parcel delivery", "broken glass bottle"][i % 2]) for i in range(24)]
    rows += [("few", 1, "s", "u", i, "FP", 0.5, "x y") for i in range(5)]
    df = spark.createDataFrame(rows, "model_name string, model_order int, split string, use_case string, id bigint, "
                                     "error_type string, y_score double, text string")
    got = error_clusters(df, EvalConfig()).collect()
    assert {r.model_name for r in got} == {"m"}
    assert sum(r.error_count for r in got) == 24
    assert all(r.fp_count + r.fn_count == r.error_count and len(r.examples) <= 5 for r in got)
    assert all(r.fp_count == 0 or r.fn_count == 0 for r in got)  # the two texts are kept apart
    assert all("parcel" in r.top_terms or "glass" in r.top_terms for r in got)


def test_clusters_do_not_depend_on_the_partitions(spark):
    words = ["late", "parcel", "glass", "broken", "refund", "again", "colour", "wrong"]
    rng = np.random.default_rng(5)
    rows = [("m", 0, "s", "u", i, "FP", 0.5, " ".join(rng.choice(words, 12))) for i in range(60)]
    df = spark.createDataFrame(rows, "model_name string, model_order int, split string, use_case string, id bigint, "
                                     "error_type string, y_score double, text string")
    found = []
    for n in (1, 5, 16):
        found.append(sorted((r.error_count, r.top_terms, [e.id for e in r.examples]) for r in error_clusters(df.repartition(n), EvalConfig()).collect()))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("n, text", [(1, "word"), (30, "a !"), (30, None)])
def test_too_few_errors_or_no_words_give_none(spark, n, text):
    df = spark.createDataFrame([("m", 0, "s", "u", i, "FP", 0.5, text) for i in range(n)], "model_name string, model_order int, split string, "
                               "use_case string, id bigint, error_type string, y_score double, text string")
    assert error_clusters(df, EvalConfig()) is None


@pytest.fixture(scope="module")
def orders(spark):
    return W.orders_predictions(spark, SF).cache()


def test_confusion_interval_holds_the_accuracy_and_repeats(orders):
    m = P.measure(orders, None, Q.CONFIG, with_ranking=False)
    key = [*KEYS, "slice_id"]
    a = I.bootstrap_confusion(m.summary(), key, Q.CONFIG).collect()
    b = I.bootstrap_confusion(m.summary().repartition(7), key, Q.CONFIG).collect()
    assert all(r.ci_low <= r.accuracy <= r.ci_high for r in a)
    assert {(r.model_name, r.split, r.ci_low, r.ci_high) for r in a} == {(r.model_name, r.split, r.ci_low, r.ci_high) for r in b}
    width = 2 * 1.96 * np.sqrt(a[0].accuracy * (1 - a[0].accuracy) / a[0].n)
    assert a[0].ci_width == pytest.approx(width, rel=0.25)


def test_own_metric_of_the_confusion(orders):
    m = P.measure(orders, None, Q.CONFIG, with_ranking=False)
    got = I.bootstrap_confusion(m.summary(), [*KEYS, "slice_id"], Q.CONFIG, lambda tn, fp, fn, tp: tp / (tp + fn)).collect()
    assert all(r.ci_low <= r.recall <= r.ci_high for r in got)


def test_score_intervals_hold_the_estimate(orders):
    p, y = F.col("y_score"), F.col("label")
    brier = I.bootstrap_mean(orders, KEYS, (p - y) * (p - y), Q.CONFIG)
    m = P.measure(orders, None, Q.CONFIG)
    point = {(r.model_name, r.split): r for r in P.overall_report(m, ["default"]).collect()}
    for r in brier.collect():
        assert r.ci_low <= point[(r.model_name, r.split)].brier <= r.ci_high
    for r in I.bootstrap_ece(orders, KEYS, EvalConfig(bootstrap_iters=40)).collect():
        assert 0 <= r.ci_low < r.ci_high < 1
    for r in I.bootstrap_ranking(orders, KEYS, EvalConfig(bootstrap_iters=40)).collect():
        assert r.ci_low <= point[(r.model_name, r.split)].roc_auc <= r.ci_high


def test_flags_name_the_first_reason(spark):
    df = spark.createDataFrame([(10, 0.5), (100, 0.5), (100, 0.05)], "n int, ci_width double")
    got = [(r.unstable, r.reason) for r in I.instability_flags(df, 50, 0.1).collect()]
    assert got == [(True, "low_sample_count"), (True, "wide_confidence_interval"), (False, "stable")]


def test_names_in_regular_expression_are_whole_words():
    assert re.fullmatch(r"\[\\p\{L\}\\p\{N\}_\]\{2,\}", T.WORD)


def _drawn(preds, draws):
    """(label, score, draw, weight) of the same numbers that the intervals draw."""
    cells = preds.groupBy(*KEYS, "y_score", "label").agg(F.count("*").alias("n")).withColumn("tag", I._tag(KEYS, EvalConfig()))
    return [(r.label, r.y_score, r.draw, r.weight) for r in R.with_draws(cells, draws, "n", "tag").collect()]


def test_ranking_draws_are_the_weighted_auc(make):
    """One draw, by pairs of rows."""
    rng = np.random.default_rng(3)
    rows = [("m", i, int(rng.random() < 0.4), float(rng.integers(0, 25)) / 25) for i in range(200)]
    got = I.bootstrap_ranking(make(rows), KEYS, EvalConfig(bootstrap_iters=1)).first()
    w = _drawn(make(rows), 1)
    pos, neg = [(s, c) for y, s, _, c in w if y], [(s, c) for y, s, _, c in w if not y]
    pairs = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
    want = pairs / (sum(a for _, a in pos) * sum(b for _, b in neg))
    assert got.ci_low == pytest.approx(want) and got.ci_high == pytest.approx(want)


def test_calibration_draws_are_the_weighted_error(make):
    rng = np.random.default_rng(8)
    rows = [("m", i, int(rng.random() < 0.4), float(rng.integers(-2, 26)) / 20) for i in range(300)]
    got = I.bootstrap_ece(make(rows), KEYS, EvalConfig(bootstrap_iters=1)).first()
    w, edges = _drawn(make(rows), 1), EvalConfig().ece_edges
    total = 0.0
    for i in range(10):
        own = [(y, s, c) for y, s, _, c in w if edges[i] <= s < edges[i + 1] or (i == 9 and s == 1)]
        total += abs(sum(c * (((s >= 0.5) == y) - s) for y, s, c in own))
    assert got.ci_low == pytest.approx(total / sum(c for *_, c in w))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 31, 32, 40, 1000, 10**6])
def test_draws_have_the_poisson_distribution(spark, n):
    """Mean, variance and, for few rows, the share of each number, over 20,000 draws."""
    cells = spark.range(100).select(F.lit(n).cast("bigint").alias("n"), R.cell_tag(1, F.col("id")).alias("tag"))
    got = np.array([r.weight for r in R.with_draws(cells, 200, "n", "tag").select("weight").collect()])
    assert abs(got.mean() - n) <= 4.5 * np.sqrt(n / 20_000)
    assert got.var() == pytest.approx(n, rel=0.05, abs=1e-9)
    if 0 < n < 6:
        for k in range(2 * n):
            p = math.exp(-n) * n**k / math.factorial(k)
            assert abs((got == k).mean() - p) < 4.5 * np.sqrt(p * (1 - p) / 20_000)


def test_both_forms_of_a_draw_are_the_same_number(spark):
    cells = spark.createDataFrame([(n, f"t{n}") for n in (0, 1, 3, 17, 31, 32, 50, 12345)], "n bigint, tag string")
    many = {(r.n, r.draw): r.weight for r in R.with_draws(cells, 20, "n", "tag").collect()}
    one = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("weight", R.poisson(F.col("n"), R.draw_hash(F.col("tag"), F.col("draw"))))
    assert {(r.n, r.draw): r.weight for r in one.collect()} == many


def test_scores_are_told_apart(spark):
    scores = [0.0, 5e-9, 0.1, 0.1 + 2**-56, 0.3, 1.0, -0.5, 1.5, 1e18, -1e18, 1e300]
    got = spark.createDataFrame([(s,) for s in scores], "s double").select("s", R.score_text(F.col("s")).alias("t")).collect()
    assert len({r.t for r in got if abs(r.s) < 1e15}) == len({s for s in scores if abs(s) < 1e15})


def test_intervals_do_not_depend_on_the_partitions(orders):
    small = orders.where("split = 'test'")
    found = [sorted(map(tuple, I.bootstrap_ranking(small.repartition(n), KEYS, EvalConfig(bootstrap_iters=10)).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_draws_without_a_value_are_left_out(spark):
    df = spark.createDataFrame([("m", 0, "s", 1, 0, 0, 0), ("m", 0, "t", 0, 0, 0, 0)], "model_name string, model_order int, split string, tn int, fp int, fn int, tp int")
    got = {r.split: (r.ci_low, r.ci_high) for r in I.bootstrap_confusion(df, KEYS, EvalConfig()).collect()}
    assert got == {"s": (1.0, 1.0), "t": (None, None)}


def test_any_metric_of_a_resample(make):
    """Each draw handed to a function, against the same draws put together by hand."""
    rng = np.random.default_rng(3)
    rows = [("m", i, int(rng.random() < 0.4), float(rng.integers(0, 25)) / 25) for i in range(200)] + [("n", i, 0, 0.5) for i in range(5)]

    def median(label, score, weight):
        return np.median(np.repeat(score[label == 1], weight[label == 1])) if (label == 1).any() else None

    got = {r.model_name: r for r in I.bootstrap_metric(make(rows), KEYS, median, EvalConfig(bootstrap_iters=30)).collect()}
    drawn = {}
    for y, s, d, w in _drawn(make(rows).where("model_name = 'm'"), 30):
        if y == 1:
            drawn.setdefault(d, []).extend([s] * w)
    values = [np.median(v) for v in drawn.values()]
    assert (got["m"].ci_low, got["m"].ci_high) == pytest.approx((np.quantile(values, 0.025), np.quantile(values, 0.975)))
    assert "n" not in got  # no draw has a value
