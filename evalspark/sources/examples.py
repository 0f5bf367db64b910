"""Labelled examples: reading, hygiene and identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from evalspark.functions.encoding import row_hash

# A loader is anything that yields examples from a session.
Loader = Callable[[SparkSession], DataFrame]


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header line. Without a schema Spark reads the file twice to infer one.

    ``multi_line`` is for values that contain line ends; such a file is read by one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def csv_loader(path: str, schema: StructType | str | None = None, multi_line: bool = False) -> Loader:
    return lambda spark: read_csv(spark, path, schema, multi_line)


def parquet_loader(path: str) -> Loader:
    return lambda spark: spark.read.parquet(path)


def content_id(df: DataFrame) -> DataFrame:
    """Add an ``id`` that depends on the row's content only: not on its position, nor on the order of the columns."""
    return df.withColumn("id", row_hash(df))


def clean_examples(df: DataFrame, label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Distinct rows with a label, the label as an integer, and an id.

    ``dropDuplicates`` combines copies before the shuffle, so a row repeated many
    times reaches the reducers at most once per task.
    """
    if label_col not in df.columns:
        raise ValueError(f"no label column '{label_col}' among {df.columns}")
    rows = df.where(F.col(label_col).isNotNull()).dropDuplicates()
    if id_col not in rows.columns:
        rows = content_id(rows).withColumnRenamed("id", id_col)
    return rows.withColumn(label_col, F.col(label_col).cast("int"))


def load(spark: SparkSession, loader: Loader, label_col: str = "label", id_col: str = "id") -> DataFrame:
    return clean_examples(loader(spark), label_col, id_col)


def non_numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType)]
