"""Deterministic train/val/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.scores import hash_uniform


def hash_split(key: Column, seed: int = 42, test_size: float = 0.2, val_size: float = 0.1) -> Column:
    """Split by a hash of the id: no shuffle, and old rows keep their split as data grow."""
    u = hash_uniform(key, F.lit(seed))
    return F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train")


def exact_split(
    df: DataFrame,
    label_col: str = "label",
    id_col: str = "id",
    seed: int = 42,
    test_size: float = 0.2,
    val_size: float = 0.1,
    cells: int = 16384,
) -> DataFrame:
    """Add ``split`` so that every label has exactly ``round(n * size)`` test and val rows.

    Rows are ordered within their label by a hashed number. The two cut points of a
    label are looked for in two steps: counts per hash cell tell which cell a cut
    falls in, and only the rows of those cells are ranked. Every row is then compared
    with its label's cuts, so the table itself is never shuffled or sorted.
    """
    placed = df.withColumn("_u", hash_uniform(F.col(id_col), F.lit(seed)))
    cell = F.floor(F.col("_u") * cells).cast("int")
    per_label = Window.partitionBy(label_col)

    counts = placed.groupBy(label_col, cell.alias("_cell")).agg(F.count("*").alias("_rows"))
    ends = counts.select(
        label_col,
        "_cell",
        "_rows",
        F.sum("_rows").over(per_label.orderBy("_cell")).alias("_end"),
        F.sum("_rows").over(per_label).alias("_n"),
    )
    test_rows = F.round(F.col("_n") * test_size).cast("bigint")
    held_rows = test_rows + F.round(F.col("_n") * val_size).cast("bigint")
    cuts = ends.select(
        "*", F.inline(F.array(F.struct(F.lit("test").alias("_cut"), test_rows.alias("_rank")),
                              F.struct(F.lit("val").alias("_cut"), held_rows.alias("_rank"))))
    ).where((F.col("_rank") > F.col("_end") - F.col("_rows")) & (F.col("_rank") <= F.col("_end")))
    cuts = cuts.select(
        label_col, "_cell", "_cut", (F.col("_rank") - (F.col("_end") - F.col("_rows"))).alias("_place")
    )

    # Two cuts per label, each with one cell: the number of classes bounds this table.
    near = placed.select(label_col, id_col, "_u", cell.alias("_cell")).join(
        F.broadcast(cuts), [label_col, "_cell"]
    )
    in_cell = Window.partitionBy(label_col, "_cut").orderBy("_u", id_col)
    last = (
        near.withColumn("_at", F.row_number().over(in_cell))
        .where(F.col("_at") == F.col("_place"))
        .groupBy(label_col)
        .agg(
            F.max(F.when(F.col("_cut") == "test", F.struct("_u", id_col))).alias("_test"),
            F.max(F.when(F.col("_cut") == "val", F.struct("_u", id_col))).alias("_val"),
        )
    )
    here = F.struct("_u", id_col)
    split = (
        F.when(here <= F.col("_test"), "test")
        .when(here <= F.col("_val"), "val")
        .otherwise("train")
    )
    return (
        placed.join(F.broadcast(last), label_col, "left")
        .withColumn("split", split)
        .drop("_u", "_test", "_val")
    )
