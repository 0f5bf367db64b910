"""Exact ROC AUC and average precision without sorting a group in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.scores import INF

# Cells of the first count over [0, 1], parts a crowded cell is cut into, and how often that is repeated at most.
CELLS, PARTS, LEVELS = 4096, 64, 6


def score_ranges(scores: DataFrame, buckets: int) -> list[float]:
    """Edges that cut the scores into ranges of like size. They only balance the work: any edges give the same metrics.

    Rows are counted per cell of a fixed grid, which combines in the tasks, so that one row per cell comes back
    however many rows there are. A cell that holds several scores and more than half a range is cut into parts and counted
    again. Scores outside [0, 1] are in the outermost ranges.
    """
    score = F.col("y_score")

    def count(cell: Column, rows: DataFrame) -> list:
        return rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")).collect()

    cell = F.least(F.greatest(F.floor(score * CELLS), F.lit(-1)), F.lit(CELLS)).cast("int")
    found = [(r.low, r.high, r.n) for r in count(cell, scores)]
    limit = max(1, sum(n for _, _, n in found) // (2 * buckets))
    for _ in range(LEVELS):
        crowded = sorted((low, high) for low, high, n in found if n > limit and low < high)
        if not crowded:
            break
        # Between the cells' own smallest and largest scores: at most 2 x buckets cells are crowded.
        place = Bucketizer(splits=[-INF, *(low for low, _ in crowded), INF], inputCol="y_score", outputCol="place")
        inside = place.transform(scores).where(F.col("place") > 0).withColumn("which", F.col("place").cast("int") - 1)
        low, high = (F.array(*[F.lit(p[k]) for p in crowded])[F.col("which")] for k in (0, 1))
        part = F.least(F.floor((score - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")
        again = count(F.struct("which", part.alias("part")), inside.where(score <= high))
        found = [x for x in found if not (x[2] > limit and x[0] < x[1])] + [(r.low, r.high, r.n) for r in again]
    edges, rows = [], 0
    for low, _, n in sorted(found):
        if rows + n > 2 * limit and rows:
            edges.append(low)
            rows = 0
        rows += n
    return sorted(set(edges))


def default_buckets(scores: DataFrame) -> int:
    """Enough ranges to keep every shuffle partition busy."""
    return max(32, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranking_metrics(
    scores: DataFrame,
    keys: list[str],
    frequencies: DataFrame | None = None,
    edges: list[float] | None = None,
) -> DataFrame:
    """ROC AUC (ties count half) and average precision per key and slice.

    ``scores`` has the keys, ``label``, ``y_score``, ``slice_ids`` and optionally a
    ``weight`` (a row count). Both metrics are null if only one class is present.
    ``edges`` is what ``score_ranges`` gives, if it is known already.

    Equal scores are combined first. The distinct scores are then distributed by score
    range and repeated per slice only inside their range, so a group, however large, is
    spread over all ranges. Each range ranks its own scores; what lies below the range
    is added from a small table of range totals.
    """
    edges = score_ranges(scores, default_buckets(scores)) if edges is None else edges
    placed = Bucketizer(splits=[-INF, *(edges or [0.5]), INF], inputCol="y_score", outputCol="bucket").transform(scores)
    # Never null: the join on it below then adds no filter, and both of its sides read one shuffle.
    bucket = F.coalesce(F.col("bucket").cast("int"), F.lit(0))
    weight = F.col("weight") if "weight" in scores.columns else F.lit(1)
    distinct = (
        placed.withColumn("bucket", bucket)
        .groupBy(*keys, "bucket", "y_score", "label", "slice_ids")
        .agg(F.sum(weight.cast("bigint")).alias("n"))
    )
    if frequencies is not None:
        few = F.broadcast(frequencies.select(*keys, "label", "freq_ids"))  # two rows per model and split
        distinct = distinct.join(few, [*keys, "label"]).withColumn("slice_ids", F.concat("slice_ids", "freq_ids"))

    # Selective columns first: they decide most comparisons of the sort.
    local = ["bucket", "slice_id", *keys]
    positive = F.col("label") == 1
    counts = [
        F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("neg"),
    ]
    ranges = distinct.repartition("bucket", *keys)
    runs = (
        ranges.withColumn("slice_id", F.explode("slice_ids"))
        .groupBy(*local, "y_score")
        .agg(*counts)
    )
    # The totals of a range need no scores: combine per set of slices before repeating.
    totals = (
        ranges.groupBy("bucket", *keys, "label", "slice_ids")
        .agg(F.sum("n").alias("n"))
        .withColumn("slice_id", F.explode("slice_ids"))
        .groupBy(*local)
        .agg(*counts)
    )
    group = [*keys, "slice_id"]
    whole = Window.partitionBy(*group)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *local,
        F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("neg_before"),
        F.sum("pos").over(whole).alias("p"),
        F.sum("neg").over(whole).alias("q"),
    )

    below = Window.partitionBy(*local).orderBy("y_score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = runs.select(
        *local,
        "pos",
        "neg",
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("pos_here"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("neg_here"),
    ).join(offsets, local)
    pos, neg, p, q = (F.col(c).cast("double") for c in ("pos", "neg", "p", "q"))
    neg_below = (F.col("neg_before") + F.col("neg_here")).cast("double")
    tp = p - (F.col("pos_before") + F.col("pos_here"))  # rows at or above this score
    fp = q - neg_below
    return (
        ranked.groupBy(*group)
        .agg(
            F.sum(pos * (neg_below + neg / 2)).alias("pairs"),
            F.sum(F.when(F.col("pos") > 0, pos * tp / (tp + fp)).otherwise(0.0)).alias("gain"),
            F.max(p).alias("p"),
            F.max(q).alias("q"),
        )
        .select(
            *group,
            F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("pairs") / (F.col("p") * F.col("q"))).alias("roc_auc"),
            F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("gain") / F.col("p")).alias("pr_auc"),
        )
    )
