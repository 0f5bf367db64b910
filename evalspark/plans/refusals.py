"""What a run would refuse or leave out, as a table, before it computes anything."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from evalspark.config import EvalConfig
from evalspark.operators.features import categorical_columns, feature_columns
from evalspark.operators.slicing import rule_mask
from evalspark.sources.examples import non_numeric

SCHEMA = "kind string, name string, column_name string, reason string"


def _missing(error: AnalysisException) -> str | None:
    """The column that could not be resolved."""
    if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
        return None
    named = (error.getMessageParameters() or {}).get("objectName", "")
    return re.sub("`", "", named) or None


def refused_inputs(examples: DataFrame, cfg: EvalConfig) -> DataFrame:
    """(kind, name, column_name, reason): every input that the flow refuses or leaves out.

    ``rule``: slice rules on a missing column (left out), that are no predicate, or that can't be read (errors);
    ``column``: a missing label column, and columns that are neither numbers nor categories among the features. Only the
    schema of ``examples`` is looked at: no row is read.
    """
    empty = examples.limit(0)
    rows = []
    for rule in cfg.rules:
        try:
            rule_mask(empty, rule.predicate)
        except ValueError:
            rows.append(("rule", rule.name, None, "not_boolean"))
        except AnalysisException as error:
            column = _missing(error)
            rows.append(("rule", rule.name, column, "missing_column" if column else "unreadable"))
    if cfg.label_col not in examples.columns:
        rows.append(("column", cfg.label_col, cfg.label_col, "missing_label"))
    features = feature_columns(examples, cfg.label_col, cfg.id_col, cfg.text_col)
    categories = categorical_columns(examples, features)
    plain = [f.name for f in examples.schema.fields if f.name in features and f.name not in categories and f.dataType.typeName() not in ("boolean", "vector", "udt")]
    rows += [("column", c, c, "not_numeric") for c in non_numeric(examples.select(*[examples[f"`{c}`"] for c in plain]))]
    return examples.sparkSession.createDataFrame(rows, SCHEMA)
