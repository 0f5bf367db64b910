"""Predictions: one long table with a row per model, split and example."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KEYS = ["model_name", "model_order", "split"]


def long_predictions(df: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """Turn one score column per model into rows; a model's order is its place in the list."""
    scores = F.array(
        *[
            F.struct(F.lit(m).alias("model_name"), F.lit(i).alias("model_order"), F.col(m).alias("y_score"))
            for i, m in enumerate(models)
        ]
    )
    return df.select(*keep, F.inline(scores))


def valid_predictions(preds: DataFrame) -> DataFrame:
    """Rows with a 0/1 label and a score that is a number."""
    score = F.col("y_score")
    return preds.where(F.col("label").isin(0, 1) & score.isNotNull() & ~F.isnan(score))


def rejected_predictions(preds: DataFrame) -> DataFrame:
    """The other rows, each with the reason it cannot be scored."""
    score = F.col("y_score")
    reason = (
        F.when(F.col("label").isNull(), "label_missing")
        .when(~F.col("label").isin(0, 1), "label_not_binary")
        .when(score.isNull(), "score_missing")
        .when(F.isnan(score), "score_not_a_number")
    )
    return preds.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def standard_columns(df: DataFrame, id_col: str, label_col: str, positive_label: int) -> DataFrame:
    """Name the columns ``id`` and ``label``; with another positive label than 1 the label becomes 0/1."""
    if id_col != "id":
        df = df.withColumnRenamed(id_col, "id")
    if label_col != "label":
        df = df.withColumnRenamed(label_col, "label")
    if positive_label != 1 and "label" in df.columns:
        df = df.withColumn("label", (F.col("label") == F.lit(positive_label)).cast("int"))
    return df


def duplicate_predictions(preds: DataFrame) -> DataFrame:
    """Ids that occur more than once for a model and split."""
    return preds.groupBy(*KEYS, "id").count().where(F.col("count") > 1)


def require_unique_ids(preds: DataFrame) -> None:
    found = duplicate_predictions(preds).take(1)
    if found:
        raise ValueError(f"duplicate prediction: {found[0].asDict()}")


def unmatched_predictions(preds: DataFrame, examples: DataFrame) -> DataFrame:
    """Predictions without an example of the same id (and split, if the examples have one)."""
    on = ["id", "split"] if "split" in examples.columns else ["id"]
    return preds.join(examples.select(*on), on=on, how="left_anti")


def save_predictions(preds: DataFrame, path: str, run_id: str) -> None:
    """One folder per run, model and split; only the folders written are replaced."""
    (
        preds.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "model_name", "split")
        .parquet(path)
    )


def load_predictions(
    spark: SparkSession,
    path: str,
    run_id: str,
    models: list[str] | None = None,
    splits: list[str] | None = None,
) -> DataFrame:
    """Predictions of a run. The filters are on folder names, so other folders are not read."""
    names = ("run_id", "model_name", "split")  # names, even where they look like numbers
    found = spark.read.parquet(path).schema
    schema = StructType([StructField(f.name, StringType()) if f.name in names else f for f in found.fields])
    df = spark.read.schema(schema).parquet(path).where(F.col("run_id") == run_id)
    if models is not None:
        df = df.where(F.col("model_name").isin(models))
    if splits is not None:
        df = df.where(F.col("split").isin(splits))
    return df
