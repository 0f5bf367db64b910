"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells of (source, language, topic). The cells' token weights are raked: scaled in turn to the
tokens wanted of each source, each language and each topic, until all three hold. A cell can't weigh more than the
tokens it has, and a value of which there are too few tokens is kept whole while the others make up for it: so a
scarce value or a stray document takes nothing from the rest of the corpus. A document is kept with the probability
its cell's weight asks for, in proportion to the tokens the cell has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .topics import train, with_topics

DIMENSIONS = ("source", "lang", "topic")
#: The mixture of the registered query and the pipeline: weights of languages; sources and topics are evened out a little.
TARGETS = {"lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}}
KEPT_SHARE = 0.7  # of the tokens
_NONE = "(null)"


def n_tokens(text: Column) -> Column:
    """White-space separated words, by counting blanks and line ends; an empty text has none."""
    bare = F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - bare + 1).cast("bigint")


def goals(cells: DataFrame, dimension: str, wanted: dict[str, float] | None, temper: float, budget: DataFrame) -> DataFrame:
    """(value, goal): the tokens wanted of each value of a dimension; together the budget, or all tokens if they are fewer.

    Shares are the wanted weights; values without one have their own share of the tokens, and without wanted weights it
    is raised to ``temper``. A value has at most the tokens there are; what it lacks goes to the others by their shares
    (the level is found over the values in order of tokens per share, one row each).
    """
    own = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("own")).where("own > 0")
    total = own.agg(F.sum("own").alias("all_tokens"))
    natural = F.pow(F.col("own") / F.col("all_tokens"), F.lit(1.0 if wanted else temper))
    own = own.join(F.broadcast(total)).withColumn("share", natural)  # one row
    if wanted:
        given = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
        own = own.withColumn("share", F.coalesce(given[F.col("value")].cast("double"), "share"))
    own = own.where("share > 0").join(F.broadcast(budget)).withColumn("room", F.col("own") / F.col("share"))
    order = Window.orderBy("room", "value")
    full = F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = own.withColumn("level", (F.col("budget") - full) / rest).where("room >= level").agg(F.min_by("level", F.struct("room", "value")).alias("level"))
    goal = F.least("own", F.coalesce(F.col("level") * F.col("share"), "own"))
    return own.drop("level").join(F.broadcast(level)).select("value", goal.alias("goal")).where("goal > 0")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, most_rounds: int = 60) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with a column ``weight``, at most ``tokens``, whose sums are the goals.

    ``targets``: for each dimension a table (value, goal). A round scales to each dimension in turn: a sum per value,
    combined in the tasks, and a join with that small sum. It is written, and the rounds end when the goals were met
    within ``tolerance`` before the scaling, when a round brought them less than a tenth nearer (goals that contradict the cells
    can't be met), or after ``most_rounds``. Cells whose value has no goal lose their weight.
    """
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d, t in targets.items():
        now = now.join(t.select(F.col("value").alias(d), F.col("goal").alias(f"{d}_goal")), d)
    now = common.written(now, "cells")
    last = math.inf
    for _ in range(most_rounds):
        before, error = now, F.lit(0.0)
        for d in targets:
            sums = now.groupBy(F.col(d).alias("_value")).agg(F.sum("weight").alias("_sum"))
            now = now.join(sums, F.col(d) == F.col("_value")).withColumn(f"_{d}_off", F.abs(F.col("_sum") / F.col(f"{d}_goal") - 1))
            scaled = F.col("weight") * F.col(f"{d}_goal") / F.col("_sum")
            now = now.withColumn("weight", F.least(scaled, F.col("tokens").cast("double"))).drop("_sum", "_value")
            error = F.greatest(error, F.col(f"_{d}_off"))
        now = common.written(now.drop("_off").withColumn("_off", error).drop(*(f"_{d}_off" for d in targets)), "cells", instead_of=before)
        off = now.agg(F.max("_off")).head()[0]
        if off is None or off < tolerance or off > 0.9 * last:
            break
        last = off
    return now.select(*targets, "tokens", "weight")


def mixed(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.9,
    topic: Column | None = None,
    tokens: int | None = None,
    share: float = 0.7,
    seed: int = 11,
) -> DataFrame:
    """One row per document: (doc_id, source, lang, topic, tokens, probability, kept).

    ``targets``: wanted weights of the values of ``source``, ``lang`` or ``topic``; a dimension without them gets its own
    shares raised to ``temper``. ``tokens``: how many to keep in expectation, by default ``share`` of all. ``topic``: an
    expression on ``text``; by default topics are learned from all documents (``topics.train``) and given to every
    whole text. Where the dimensions contradict each other, wanted weights are met before own shares. The draw is a hash of doc_id and ``seed``: the same documents are kept in every run and on every
    partitioning; rows that share an id share the draw.

    A null source or language is the value ``(null)``; a null doc_id is drawn as an id of its own. Documents without tokens
    weigh nothing and are not kept. An empty table gives none. Other columns are not read.
    """
    read = common.texts(docs, *(F.coalesce(F.col(d).cast("string"), F.lit(_NONE)).alias(d) for d in DIMENSIONS[:2])).withColumn("tokens", n_tokens(F.col("text")))
    if topic is None:
        rows = with_topics(read, train(docs), "doc_id", "source", "lang", "tokens")
    else:
        rows = read.select("doc_id", "source", "lang", "tokens", F.coalesce(topic.cast("string"), F.lit(_NONE)).alias("topic"))
    rows = common.written(rows, "documents")
    cells = common.written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    whole = F.sum("tokens").cast("double")
    budget = cells.agg((whole * share if tokens is None else F.least(whole, F.lit(float(tokens)))).alias("budget"))
    wanted = targets or {}
    order = sorted(DIMENSIONS, key=lambda d: d in wanted)  # the last one scaled is met best
    raked = rake(cells, {d: goals(cells, d, wanted.get(d), temper, budget) for d in order}, tolerance=1e-3)
    chance = raked.select(*(F.col(d).alias(f"of_{d}") for d in DIMENSIONS), (F.col("weight") / F.col("tokens")).alias("chance"))
    joined = rows.join(chance, [F.col(d) == F.col(f"of_{d}") for d in DIMENSIONS], "left")
    probability = F.when(F.col("tokens") > 0, F.coalesce("chance", F.lit(0.0))).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53))
    return joined.select(common.real_id("doc_id").alias("doc_id"), *DIMENSIONS, "tokens", probability.alias("probability"), (draw < probability).alias("kept"))
