"""Evaluation inputs derived from the warehouse tables (orders, documents, line items, vectors).

Labels come from a column of the table. Scores mix the label with a number hashed
from the row's key, so that any SQL engine can derive the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.scores import hash_uniform
from evalspark.operators.splits import hash_split
from evalspark.sources.predictions import long_predictions

MODELS = ["model_a", "model_b"]


# The columns used of each table. A given schema spares Spark a look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute a table that is read by fewer tasks than there are cores.

    A file with one row group is read by one task; hashing or tokenising its rows should
    not stay there. A table of many row groups is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def _score(weight: float, label: Column, noise: Column) -> Column:
    return F.round(F.lit(weight) * label + F.lit(round(1.0 - weight, 2)) * noise, 4)


def _length_score() -> Column:
    """Length over 20,000, at most 1, to four places. Counted in whole steps of 1/10,000,
    half a step up, because half steps do occur and engines round them differently."""
    return F.least(F.floor((F.col("n_chars") + 1) / 2), F.lit(10000)) / F.lit(10000.0)


def orders_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: id, split, label and both scores. Reads ``orders`` only."""
    label = (F.col("o_orderstatus") == "F").cast("int")
    orders = spread(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label")), "id"
    )
    a, b = (hash_uniform(F.col("id"), F.lit(tag)) for tag in ("a", "b"))
    return orders.select(
        "id",
        hash_split(F.col("id")).alias("split"),
        "label",
        _score(0.35, F.col("label"), a).alias("model_a"),
        _score(0.25, F.col("label"), b).alias("model_b"),
    )


def orders_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_predictions(orders_scores(spark, sf_dir), MODELS, ["split", "id", "label"])


def orders_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the metadata that slices refer to."""
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", F.col("r_name").alias("region"))
    )
    details = F.repeat(F.lit(" detail"), (F.col("o_orderkey") % 30).cast("int"))
    return (
        spread(table(spark, sf_dir, "orders"), "o_orderkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            hash_split(F.col("o_orderkey")).alias("split"),
            (F.col("o_orderstatus") == "F").cast("int").alias("label"),
            "region",
            F.col("o_totalprice").alias("amount"),
            F.concat("c_mktsegment", F.lit(" "), "o_orderpriority", details).alias("text"),
        )
    )


def docs_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their texts; a document of low quality is the positive class."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id")
        .select(F.col("doc_id").alias("id"), "label", "text", "lang", "source")
    )


def docs_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    scored = (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.lit("all").alias("split"),
            "label",
            _score(0.4, F.col("label"), hash_uniform(F.col("doc_id"), F.lit("a"))).alias("model_a"),
            _length_score().alias("model_b"),
        )
    )
    return long_predictions(scored, MODELS, ["split", "id", "label"])


def docs_unlabelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored, labelled or not."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    scored = (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.lit("all").alias("split"),
            "label",
            _length_score().alias("model_b"),
        )
    )
    return long_predictions(scored, ["model_b"], ["split", "id", "label"])


def lineitem_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without a unique id, for metrics that need none."""
    key = [
        F.col(c).cast("bigint")
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    ]
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    label = (F.col("l_returnflag") == "R").cast("int")
    scored = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").select(
        F.lit("all").alias("split"),
        label.alias("label"),
        _score(0.35, label, hash_uniform(*key, cents, day, F.lit("a"))).alias("model_a"),
        _score(0.25, label, hash_uniform(*key, cents, day, F.lit("b"))).alias("model_b"),
    )
    return long_predictions(scored, MODELS, ["split", "label"])


def embedding_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with 64 features; label 0-9."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
