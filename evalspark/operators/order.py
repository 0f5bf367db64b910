"""A global order as a column, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.storage import materialize


def numbered(df: DataFrame, by: list[str | Column], name: str = "position") -> DataFrame:
    """Add the place of each row in the order of ``by``, from 1, so that the order survives being stored.

    Rows are dealt by ranges of ``by`` and written; a row's place is the number of rows in the ranges before (a table of
    one row per range) and its place inside. Rows equal in ``by`` share a range and are numbered arbitrarily.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(df.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = table.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_range"), F.coalesce(before, F.lit(0)).alias("_before"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return table.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def level_numbers(df: DataFrame, column: str) -> DataFrame:
    """The different values of a column, nulls left out, as a table (level, number): numbers from 0 in the order of the
    values. Written once; nothing of it passes through the driver."""
    levels = df.select(F.col(f"`{column}`").alias("level")).where("level IS NOT NULL").distinct()
    return materialize(numbered(levels, ["level"], "_place").select("level", (F.col("_place") - 1).alias("number")), "levels")
