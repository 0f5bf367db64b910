"""Overlapping slices: which rows belong to which named subset."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from evalspark.config import EvalConfig, SliceRule
from evalspark.functions import scores as S
from evalspark.sources.predictions import KEYS

ALL = "__all__"


@dataclass(frozen=True)
class Slice:
    name: str
    description: str
    family: str
    low: float | None = None
    high: float | None = None


@dataclass
class SlicedScores:
    """Scores with ``slice_ids``: the positions in ``slices`` of the row's slices.

    Label-frequency slices are missing from ``slice_ids``: they follow from the label
    counts of the whole model and split, see ``label_frequency_ids``.
    """

    scores: DataFrame
    slices: list[Slice]
    skipped: list[tuple[SliceRule, str]] = field(default_factory=list)


def rule_mask(df: DataFrame, predicate: str) -> Column:
    """The predicate as a mask over ``df``: unknown (null) counts as outside.

    Raises ``AnalysisException`` for a column that ``df`` does not have and
    ``ValueError`` for an expression that is not boolean.
    """
    resolved = df.select(F.expr(predicate).alias("mask")).schema["mask"]
    if not isinstance(resolved.dataType, BooleanType):
        raise ValueError(f"slice rule '{predicate}' is {resolved.dataType.simpleString()}, not boolean")
    return F.coalesce(F.expr(predicate), F.lit(False))


def try_rule(df: DataFrame, rule: SliceRule) -> Column | None:
    """The rule's mask, or None if a column is missing."""
    try:
        return rule_mask(df, rule.predicate)
    except AnalysisException as error:
        if (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            return None
        raise


def mentions(rule: SliceRule, columns: list[str]) -> bool:
    """Does the rule name one of the columns, if only in a string?"""
    words = {w.lower() for w in re.findall(r"\w+", rule.predicate)}
    return any(c.lower() in words for c in columns)


def models_disagree(same_id: Window, score: Column, threshold: float = 0.5) -> Column:
    """True where the models vote differently; null if only one model scored the row."""
    vote = S.predicted(score, threshold)
    return F.when(
        F.min("model_name").over(same_id) < F.max("model_name").over(same_id),
        F.min(vote).over(same_id) < F.max(vote).over(same_id),
    )


def _scored_twice(same_id: Window) -> Column:
    """True on the second of two scores by one model for one id."""
    by_model = same_id.orderBy("model_name")
    return F.coalesce(F.lag("model_name").over(by_model) == F.col("model_name"), F.lit(False))


def _members(masks: list[tuple[int, Column]]) -> Column:
    """The positions whose mask holds, as an array of integers (compiled, no lambda)."""
    none = F.array().cast("array<int>")
    if not masks:
        return none
    return F.concat(*[F.when(mask, F.array(F.lit(i))).otherwise(none) for i, mask in masks])


def _binned(slices: list[Slice], family: str, value: Column) -> list[tuple[int, Column]]:
    return [(i, S.in_bin(value, s.low, s.high)) for i, s in enumerate(slices) if s.family == family]


def _catalog(cfg: EvalConfig, rules: list[SliceRule], has_text: bool) -> list[Slice]:
    out = [Slice(ALL, "Every scored row", "all")]
    out += [Slice(r.name, r.description, "rule") for r in rules]
    if not cfg.auto_slices:
        return out
    families = [("confidence", "By the score of the likelier class", cfg.confidence_bins),
                ("label_freq", "By the share of the row's label", cfg.label_freq_bins)]
    if has_text:
        families.insert(0, ("text_len", "By characters of text", cfg.text_length_bins))
    for family, description, edges in families:
        out += [Slice(S.bin_name(family, lo, hi), description, family, lo, hi) for lo, hi in S.bins(edges)]
    if cfg.difficulty:
        out += [Slice("easy_examples", "The models agree on the row", "easy"),
                Slice("hard_examples", "The models disagree on the row, or the only one is unsure", "hard")]
    return out


def overall_scores(preds: DataFrame) -> SlicedScores:
    """No slices but the whole: predictions alone, no join."""
    ids = F.array(F.lit(0))
    return SlicedScores(preds.withColumn("slice_ids", ids), [Slice(ALL, "Every scored row", "all")])


def assign_slices(preds: DataFrame, examples: DataFrame, cfg: EvalConfig) -> SlicedScores:
    """Join predictions with their examples and note the slices of every row.

    Whatever depends on the example alone (text length, rules on metadata) is
    evaluated before the join, so that texts never travel through the shuffle. The
    model votes are compared over the same distribution by id that the join needs.
    The label of the prediction counts, not the one on the example.

    A scored row without an example stays: it is in the whole and in the slices by score, and in no slice that
    looks at the example. An example that occurs twice would count its scores twice and is an error.
    """
    on = ["id", "split"] if "split" in examples.columns else ["id"]
    metadata = examples.drop("label", "y_score", *[k for k in KEYS if k != "split"])
    has_text = cfg.text_col is not None and cfg.text_col in examples.columns

    # Spark's analyzer tells which rules resolve, over an empty table of the same columns.
    # A rule that may need the scores waits for the join; that is never wrong, only later.
    own = [f for f in preds.schema.fields if f.name not in metadata.columns]
    blank = preds.sparkSession.createDataFrame([], StructType([*metadata.schema.fields, *own]))
    early_masks, late_masks, resolved, skipped = [], [], [], []
    for rule in cfg.rules:
        mask = try_rule(blank, rule)
        if mask is None:
            skipped.append((rule, "missing column"))
            continue
        resolved.append(rule)
        late = mentions(rule, [f.name for f in own])
        (late_masks if late else early_masks).append((len(resolved), mask))
    slices = _catalog(cfg, resolved, has_text)
    if has_text:
        early_masks += _binned(slices, "text_len", S.text_length(F.col(cfg.text_col)))
    late_masks += _binned(slices, "confidence", S.confidence(F.col("y_score")))

    if any(s.family == "hard" for s in slices):
        # One sort by id and model serves the votes, the check for repeated ids and the join. Votes are
        # compared within a split; where examples have none, the join needs the rows by id alone.
        if on == ["id"]:
            preds = preds.repartition("id")
        same_id = Window.partitionBy("id", "split")
        votes = same_id.orderBy("model_name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        hard = F.coalesce(
            models_disagree(votes, F.col("y_score")),
            S.is_uncertain(F.col("y_score"), cfg.uncertain_margin),
        )
        twice = F.raise_error(F.concat(F.lit("duplicate prediction of id "), F.col("id").cast("string")))
        preds = preds.withColumns({"_hard": hard, "_twice": _scored_twice(same_id)})
        preds = preds.withColumn("_hard", F.when(F.col("_twice"), twice.cast("boolean")).otherwise(F.col("_hard")))
        position = {s.family: i for i, s in enumerate(slices) if s.family in ("easy", "hard")}
        late_masks += [(position["easy"], ~F.col("_hard")), (position["hard"], F.col("_hard"))]

    again = (F.count(F.lit(1)).over(Window.partitionBy(*on)) > 1) & F.col("id").isNotNull()
    repeated = F.raise_error(F.concat(F.lit("duplicate example of id "), F.col("id").cast("string"))).cast("array<int>")
    tagged = metadata.withColumn("_early", _members(early_masks))
    tagged = tagged.withColumn("_early", F.when(again, repeated).otherwise(F.col("_early")))
    none = F.array().cast("array<int>")
    ids = F.sort_array(F.concat(F.array(F.lit(0)), F.coalesce(F.col("_early"), none), _members(late_masks)))
    # Both sides grow with the data. The votes already distribute and sort the predictions
    # by id, so a merge join only has to bring the narrow example side along.
    scores = preds.join(tagged.hint("merge"), on, "left").withColumn("slice_ids", ids)
    keep = [c for c in preds.columns if c not in ("_hard", "_twice")]
    return SlicedScores(scores.select(*keep, "slice_ids"), slices, skipped)


def skipped_rules(skipped: list[tuple[SliceRule, str]], spark: SparkSession) -> DataFrame:
    """The rules left out, with the reason."""
    rows = [(rule.name, rule.predicate, reason) for rule, reason in skipped]
    return spark.createDataFrame(rows, "slice_name string, predicate string, reason string")


def label_frequency_ids(label_counts: DataFrame, slices: list[Slice]) -> DataFrame:
    """Per model, split and label: the label's relative frequency and the slice it selects.

    ``label_counts`` holds (keys, label, n); the result has two rows per model and split.
    """
    whole = Window.partitionBy(*KEYS)
    counts = label_counts.groupBy(*KEYS, "label").agg(F.sum("n").alias("n"))
    freq = counts.withColumn("label_freq", F.col("n") / F.sum("n").over(whole))
    return freq.withColumn("freq_ids", _members(_binned(slices, "label_freq", F.col("label_freq"))))


def with_label_frequency(df: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Append the label-frequency slice to ``slice_ids``."""
    few = F.broadcast(frequencies.select(*KEYS, "label", "freq_ids"))  # two rows per model and split
    return df.join(few, [*KEYS, "label"]).withColumn("slice_ids", F.concat("slice_ids", "freq_ids")).drop("freq_ids")


def slice_columns(df: DataFrame, slices: list[Slice]) -> DataFrame:
    """Replace ``slice_id`` by the slice's name and description."""
    def pick(values):
        return F.array(*[F.lit(v) for v in values])[F.col("slice_id")]

    return df.select(
        pick([s.name for s in slices]).alias("slice_name"),
        pick([s.description for s in slices]).alias("slice_description"),
        *[c for c in df.columns if c != "slice_id"],
    )
