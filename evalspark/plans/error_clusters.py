"""Failure clusters of every model's errors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.operators.text import cluster_texts, energy, misplaced, summarize_clusters, tfidf_rows, tokens
from evalspark.storage import materialize


GROUP = ["model_name", "split", "use_case"]


def _groups(errors: DataFrame, cfg: EvalConfig) -> Iterator[tuple[Row, DataFrame]]:
    """Of each model (and split and use case) with enough errors: its row, with their number, and its errors."""
    errors = materialize(errors, "errors")  # read once per model
    sizes = errors.groupBy(*GROUP).count().where(F.col("count") >= cfg.min_errors_to_cluster)
    for row in sizes.orderBy(*GROUP).collect():  # one row per model, split and use case
        yield row, errors.where(reduce(lambda a, b: a & b, [F.col(c) == row[c] for c in GROUP]))


def error_clusters(errors: DataFrame, cfg: EvalConfig, stop_words: list[str] | None = None) -> DataFrame | None:
    """Cluster the errors of each model (and split and use case) that has enough of them.

    Each model has its own vocabulary and clusters, so the fits run one model after
    another; the loop is over models, never over rows. None if no model has enough.
    """
    found = [cluster_texts(own, row["count"], cfg, stop_words) for row, own in _groups(errors, cfg)]
    reports = [summarize_clusters(x.rows, x.terms, cfg) for x in found if x is not None]
    return reduce(DataFrame.unionByName, reports) if reports else None


def cluster_checks(errors: DataFrame, cfg: EvalConfig, stop_words: list[str] | None = None) -> DataFrame | None:
    """Per model: what its clusters and their latent space keep, computed apart from the code that made them.

    ``n_misplaced`` errors have a nearer centre than their own; ``n_other_terms`` of the leading terms are not those that
    plain sums of the TF-IDF rows give; ``total`` is the sum of squares of these rows; ``captured`` the part of it inside the latent space; ``skew`` the
    largest entry by which its basis is not orthonormal; ``off`` the largest difference between a squared singular value and the rows'
    squares along its vector, as a share of the total.
    """
    reports = []
    for row, own in _groups(errors, cfg):
        found = cluster_texts(own, row["count"], cfg, stop_words)
        if found is None:
            continue
        docs = own.withColumn("tokens", tokens(F.col("text"), stop_words))
        matrix = materialize(tfidf_rows(docs, GROUP, cfg.max_terms), "error-matrix")
        named = materialize(found.rows.select("id", "cluster"), "error-assigned")
        rank = Window.partitionBy("cluster").orderBy(F.round("weight", 9).desc(), "term")
        sums = matrix.join(named, "id").groupBy("cluster", "term").agg(F.sum("weight").alias("weight"))
        plain = sums.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= cfg.top_terms)
        told = summarize_clusters(found.rows, found.terms, cfg).select("cluster", F.posexplode("top_terms").alias("rank", "term"))
        other = told.withColumn("rank", F.col("rank") + 1).exceptAll(plain.select("cluster", "rank", "term"))
        total = matrix.agg(F.sum(F.col("weight") * F.col("weight")).alias("total"))
        kept = energy(found.rows)
        squares = F.array(*[F.lit(float(v * v)) for v in found.values])
        off = F.array_max(F.zip_with("per_dimension", squares, lambda a, b: F.abs(a - b)))
        skew = float(abs(found.basis.T @ found.basis - np.eye(found.basis.shape[1])).max())
        reports.append(
            misplaced(found).agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("n_clusters"), F.sum("n_misplaced").alias("n_misplaced"))
            .crossJoin(other.agg(F.count("*").alias("n_other_terms"))).crossJoin(total).crossJoin(kept.select("captured", "per_dimension"))
            .select(*[F.lit(row[c]).alias(c) for c in GROUP], "n", "n_clusters", "n_misplaced", "n_other_terms", F.lit(len(found.values)).alias("dimensions"),
                    "total", "captured", F.lit(skew).alias("skew"), (off / F.col("total")).alias("off"))
        )
    return reduce(DataFrame.unionByName, reports) if reports else None
