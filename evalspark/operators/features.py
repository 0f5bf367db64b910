"""From examples to a numeric feature vector."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from evalspark.operators.order import level_numbers
from evalspark.sources.examples import non_numeric


def feature_columns(df: DataFrame, label_col: str = "label", id_col: str = "id", text_col: str | None = "text") -> list[str]:
    """All columns but label, id, text and split."""
    return [c for c in df.columns if c not in (label_col, id_col, text_col, "split")]


def category_levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The sorted levels of each column over all splits, null left out. For the wide form: levels become columns."""
    return {c: [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()] for c in columns}


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Replace each column by one 0/1 column per level; a null or unknown value gives zeros."""
    kept = [c for c in df.columns if c not in levels]
    flags = [
        F.coalesce((F.col(c) == F.lit(level)).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c, values in levels.items()
        for level in values
    ]
    return df.select(*kept, *flags)


def categorical_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, StringType)]


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """One vector from numeric columns; booleans count as numbers, anything else is an error."""
    for f in df.schema.fields:
        if f.name in columns and isinstance(f.dataType, BooleanType):
            df = df.withColumn(f.name, F.col(f.name).cast("int"))
    plain = [f.name for f in df.schema.fields if f.name in columns and not isinstance(f.dataType, VectorUDT)]
    bad = non_numeric(df.select(*[F.col(f"`{c}`") for c in plain]))
    if bad:
        raise ValueError(f"non-numeric columns among the features: {bad}")
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="error").transform(df)


def place_levels(df: DataFrame, columns: list[str], dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add ``<column>__place``: the number of each category's level, as in ``level_numbers``, null for a null or unknown one.

    ``dictionaries`` are tables of levels from another time; by default they are made from ``df``, over all its rows.
    Levels are joined back on their values; Spark sends a table of levels to the tasks only if it is small.
    """
    for c in columns:
        levels = level_numbers(df, c) if dictionaries is None else dictionaries[c]
        numbers = levels.select(F.col("level").alias(f"{c}__level"), F.col("number").alias(f"{c}__place"))
        df = df.join(numbers, F.col(f"`{c}`") == F.col(f"`{c}__level`"), "left").drop(f"{c}__level")
    return df


def encode(df: DataFrame, label_col: str = "label", id_col: str = "id", text_col: str | None = "text") -> DataFrame:
    """One-hot encode over all splits at once and assemble; keeps id, label and split.

    A category is one sparse block of the vector, however many levels it has; null is all zeros. Levels are numbered in
    a written table, so none passes through the driver; only their number does.
    """
    columns = feature_columns(df, label_col, id_col, text_col)
    categories = categorical_columns(df, columns)
    keep = [c for c in (id_col, label_col, "split") if c in df.columns]
    if categories:
        places, blocks = ([f"{c}__{kind}" for c in categories] for kind in ("place", "levels"))
        df = place_levels(df, categories)
        most = df.agg(*[F.max(p).alias(p) for p in places]).head()
        # a null goes one place behind the last level, which is the place that is dropped
        df = df.withColumns({p: F.coalesce(F.col(p), F.lit(-1 if most[p] is None else most[p]) + 1).cast("double") for p in places})
        sizes = df.sparkSession.createDataFrame([[float(1 + (-1 if most[p] is None else most[p])) for p in places]], places)
        df = OneHotEncoder(inputCols=places, outputCols=blocks, dropLast=True, handleInvalid="error").fit(sizes).transform(df)
        columns = [c for c in columns if c not in categories] + blocks
    return assemble(df, columns).select(*keep, "features")
