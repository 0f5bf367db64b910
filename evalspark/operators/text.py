"""Words, TF-IDF, latent dimensions and clusters of error texts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.config import EvalConfig
from evalspark.functions.scores import clean_text
from evalspark.functions.stopwords import ENGLISH
from evalspark.storage import materialize

# Fixed value: a word is two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
# Errors are dealt by id into tasks of about so many before a fit: how many tasks depends on the errors alone, so fits
# don't depend on how the input was dealt. A task holds their texts and tokens.
FIT_ROWS = 5_000


def words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words without stop words."""
    found = F.regexp_extract_all(F.lower(clean_text(text)), F.lit(WORD), F.lit(0))
    stop = ENGLISH if stop_words is None else stop_words
    if not stop:
        return found
    return F.filter(found, lambda word: ~word.isin(*stop))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words and pairs of neighbouring words, after the stop words are gone."""
    single = words(text, stop_words)
    gaps = F.greatest(F.size(single) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(single, 1, gaps), F.slice(single, 2, gaps), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(single, pairs)


def tfidf_rows(docs: DataFrame, group: list[str], max_terms: int) -> DataFrame:
    """The TF-IDF matrices of all groups at once, as rows (group, id, term, count, weight).

    ``docs`` has the group columns, ``id`` (once in a group) and ``tokens``. A group's vocabulary are its ``max_terms``
    most frequent terms, of equally frequent ones the first by name; weights as in ``tfidf``. Everything is a sum by
    (group, term) or (group, id): counts combine in the tasks, and no vocabulary passes through the driver. Texts are
    parsed once, into a written table of counts; a group's terms are ranked in parts before the parts' best meet.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(*group).agg(F.count("*").alias("_n"))
    # The outer form: of the inner one Spark makes a filter on the tokens, and parses all texts of the table for it.
    found = docs.select(*group, "id", F.posexplode_outer("tokens").alias("_pos", "term")).where("_pos IS NOT NULL")
    cells = materialize(found.groupBy(*group, "id", "term").agg(F.count("*").alias("count")), "term-counts")
    terms = cells.groupBy(*group, "term").agg(F.sum("count").alias("_total"), F.count("*").alias("_df"))
    part = F.pmod(F.xxhash64("term"), F.lit(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    kept = terms.withColumn("_part", part)
    for keys in ([*group, "_part"], group):
        rank = Window.partitionBy(*keys).orderBy(F.col("_total").desc(), "term")
        kept = kept.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= max_terms)
    idf = F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1
    weights = kept.join(sizes, group).select(*group, "term", idf.alias("_idf"))  # at most max_terms rows of a group
    rows = cells.join(F.broadcast(weights), [*group, "term"]).withColumn("_raw", F.col("count") * F.col("_idf"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*group, "id")))
    return rows.select(*group, "id", "term", "count", (F.col("_raw") / length).alias("weight"))


def vocabulary(docs: DataFrame, max_terms: int) -> list[str]:
    """The most frequent terms of ``tokens``; of equally frequent ones the first by name."""
    counts = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return [r.term for r in counts.orderBy(F.col("n").desc(), "term").limit(max_terms).collect()]


def tfidf(docs: DataFrame, max_terms: int) -> tuple[DataFrame, list[str]]:
    """Add ``tfidf``: term count times (ln((n+1)/(df+1)) + 1), each row of length 1."""
    terms = vocabulary(docs, max_terms)
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="counts")
    counted = counter.transform(docs)
    idf = IDF(inputCol="counts").fit(counted).idf.toArray() + 1.0
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weights").transform(counted)
    unit = Normalizer(p=2.0, inputCol="weights", outputCol="tfidf").transform(scaled)
    return unit.drop("counts", "weights", "tokens"), terms


def latent_space(docs: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of the uncentred TF-IDF rows (terms x dimensions), and the singular values."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(docs.select("tfidf"), "tfidf"))
    held = matrix._java_matrix_wrapper._java_model.rows().cache()  # read once per step otherwise; what doesn't fit still is
    found = matrix.computeSVD(dimensions)
    basis, values = found.V.toArray(), found.s.toArray()
    held.unpersist(False)
    return basis, values


def latent_basis(docs: DataFrame, dimensions: int) -> np.ndarray:
    return latent_space(docs, dimensions)[0]


def energy(latent: DataFrame) -> DataFrame:
    """What the latent dimensions keep, in one pass: (n, total, captured, per_dimension).

    ``total`` is the sum of squares of the TF-IDF rows, ``per_dimension`` that of each latent feature: for singular
    vectors these are the squared singular values, so ``captured`` (their sum) plus the squared distance of the rows
    from the latent space is the total.
    """
    square = F.aggregate(F.unwrap_udt("tfidf")["values"], F.lit(0.0), lambda a, x: a + x * x)
    wide = latent.select(square.alias("square"), vector_to_array("features").alias("f"))
    each = wide.select("square", F.transform("f", lambda x: x * x).alias("f"))
    total = each.agg(F.count("*").alias("n"), F.sum("square").alias("total"), Summarizer.sum(array_to_vector("f")).alias("_sums"))
    sums = vector_to_array("_sums")
    return total.select("n", "total", F.aggregate(sums, F.lit(0.0), lambda a, x: a + x).alias("captured"), sums.alias("per_dimension"))


def project(docs: DataFrame, basis: np.ndarray) -> DataFrame:
    """Add ``features``: the row's TF-IDF vector in the latent dimensions."""
    shared = docs.sparkSession.sparkContext.broadcast(basis)  # terms x dimensions doubles, both bounded by the settings

    @F.pandas_udf("array<double>")
    def onto_basis(indices: pd.Series, values: pd.Series) -> pd.Series:
        v = shared.value
        return pd.Series([(w @ v[i]) if len(i) else np.zeros(v.shape[1]) for i, w in zip(indices, values)])

    raw = F.unwrap_udt(F.col("tfidf"))
    return docs.withColumn("features", array_to_vector(onto_basis(raw["indices"], raw["values"])))


def cluster_count(n: int, most: int) -> int:
    return min(most, max(2, int(math.sqrt(n / 2))))


@dataclass
class Clustering:
    """Errors of one model with their cluster, TF-IDF vector and latent features; the terms, centres and the latent
    space (basis, singular values) behind them, all bounded by the settings."""

    rows: DataFrame
    terms: list[str]
    centers: list[np.ndarray]
    basis: np.ndarray
    values: np.ndarray


def cluster_texts(errors: DataFrame, n: int, cfg: EvalConfig, stop_words: list[str] | None = None) -> Clustering | None:
    """Cluster one model's ``n`` errors by their texts; the rows get ``cluster``, ``tfidf`` and ``features``.

    The rows are written once as tokens, once as TF-IDF vectors and once as latent
    features: the iterative fits then read small tables instead of parsing texts on every
    pass. None if no text holds a word.
    """
    dealt = errors.withColumn("tokens", tokens(F.col("text"), stop_words)).repartition(math.ceil(n / FIT_ROWS), "id").sortWithinPartitions("id")
    docs = materialize(dealt, "error-tokens")
    if docs.where(F.size("tokens") > 0).isEmpty():
        return None
    vectors, terms = tfidf(docs, cfg.max_terms)
    vectors = materialize(vectors, "error-tfidf")
    dimensions = min(cfg.max_dimensions, len(terms) - 1) if len(terms) > 1 else 1
    basis, values = latent_space(vectors, dimensions)
    latent = materialize(project(vectors, basis), "error-latent")
    model = KMeans(k=cluster_count(n, cfg.max_clusters), seed=cfg.seed, featuresCol="features", predictionCol="cluster").fit(latent)
    return Clustering(model.transform(latent), terms, model.clusterCenters(), basis, values)


def misplaced(found: Clustering) -> DataFrame:
    """(cluster, n, n_misplaced): how many rows have a centre nearer than that of their cluster (beyond rounding).

    The distances are column expressions over literal centres: one pass, apart from the code that made the clusters.
    """
    x = vector_to_array("features")

    def distance(center: np.ndarray) -> Column:
        at = F.array(*[F.lit(float(v)) for v in center])
        return F.aggregate(F.zip_with("x", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    rows = found.rows.select("cluster", x.alias("x")).select("cluster", F.array(*[distance(c) for c in found.centers]).alias("d"))
    wrong = F.col("d")[F.col("cluster")] > F.array_min("d") + 1e-9
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_misplaced"))


def summarize_clusters(clustered: DataFrame, terms: list[str], cfg: EvalConfig) -> DataFrame:
    """Per cluster: size, error mix, leading terms by mean TF-IDF, and example rows."""
    group = [c for c in ("model_name", "model_order", "split", "use_case") if c in clustered.columns] + ["cluster"]
    totals = clustered.groupBy(*group).agg(
        F.count("*").alias("error_count"),
        F.count_if(F.col("error_type") == "FP").alias("fp_count"),
        F.count_if(F.col("error_type") == "FN").alias("fn_count"),
        vector_to_array(Summarizer.mean(F.col("tfidf"))).alias("mean_tfidf"),
    )
    # One row per cluster and term of the vocabulary: bounded by the settings.
    names = clustered.sparkSession.createDataFrame(list(enumerate(terms)), "pos int, term string")
    heavy = Window.partitionBy(*group).orderBy(F.col("weight").desc(), "term")
    leading = (
        totals.select(*group, F.posexplode("mean_tfidf").alias("pos", "weight"))
        .where(F.col("weight") > 0)
        .join(F.broadcast(names), "pos")
        .withColumn("rank", F.row_number().over(heavy))
        .where(F.col("rank") <= cfg.top_terms)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term")))["term"].alias("top_terms"))
    )
    first = Window.partitionBy(*group).orderBy("id")
    examples = (
        clustered.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= cfg.cluster_examples)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "id", "text", "y_score", "error_type"))).alias("examples"))
    )
    return totals.drop("mean_tfidf").join(leading, group, "left").join(examples, group)
