"""Model evaluation as a decision problem, on Spark DataFrames."""

from evalspark.config import EvalConfig, SliceRule

__all__ = ["EvalConfig", "SliceRule"]
