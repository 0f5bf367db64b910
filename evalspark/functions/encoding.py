"""One way to write a row as text that every engine can follow: type tag, length, value, column by column.

A null is ``n``; any other value is ``tag:length:text`` with the length in bytes, so that neighbouring values can't run
into each other. Columns come in the order of their names. Fixed values, as texts:

* ``i`` integers and decimals in digits, ``b`` booleans as true or false, ``s`` strings, ``x`` binary in hexadecimal;
* ``f`` floats and doubles as whole part (rounded down), point, fraction in 62 binary places and point, the next 62;
  from 2^53 on in digits without a fraction; below 2^-60, from 2^62 on, infinite or not a number as Spark writes them;
* ``d`` dates and ``t`` timestamps as year-month-day hour:minute:second.microseconds;
* ``a`` arrays and ``r`` structs: their elements written the same way one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_FINE = 2.0**62


def _tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"{tag}:"), F.octet_length(text).cast("string"), F.lit(":"), text)


def _double_text(x: Column) -> Column:
    size = F.abs(x)
    whole, rest = F.floor(x).cast("bigint"), (x - F.floor(x)) * F.lit(_FINE)
    fine = F.concat_ws(".", whole.cast("string"), F.floor(rest).cast("bigint").cast("string"), F.floor((rest - F.floor(rest)) * F.lit(_FINE)).cast("bigint").cast("string"))
    plain = F.isnan(x) | (size >= _FINE) | ((size < 2.0**-60) & (x != 0))
    return F.when(plain, x.cast("string")).when(size >= 2.0**53, x.cast("bigint").cast("string")).otherwise(fine)


def value_text(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _INTEGERS):
        text = _tagged("i", x.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = _tagged("f", _double_text(x.cast("double")))
    elif isinstance(kind, T.BooleanType):
        text = _tagged("b", x.cast("string"))
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        text = _tagged("s", x.cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = _tagged("x", F.lower(F.hex(x)))
    elif isinstance(kind, T.DateType):
        text = _tagged("d", F.date_format(x, "yyyy-MM-dd"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = _tagged("t", F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif isinstance(kind, T.ArrayType):
        text = _tagged("a", F.concat_ws("", F.transform(x, lambda v: value_text(v, kind.elementType))))
    elif isinstance(kind, T.StructType):
        text = _tagged("r", F.concat(*[value_text(x[f.name], f.dataType) for f in kind.fields]))
    else:
        raise ValueError(f"no text for values of type {kind.simpleString()}")
    return F.when(x.isNull(), F.lit("n")).otherwise(text)


def row_text(df: DataFrame) -> Column:
    """The row as text; equal rows, and only they, have equal texts."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.concat(F.lit(""), *[value_text(F.col(f"`{f.name}`"), f.dataType) for f in fields])


def row_hash(df: DataFrame) -> Column:
    return F.sha2(row_text(df), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n_rows, fingerprint) that depends on the rows and how often each occurs, not on their order or place.

    Two parts of 60 bits of each row's hash are added up, which combines in the tasks; the digest of the sums and the
    count is the fingerprint.
    """
    parts = [F.conv(F.substring(F.col("_hash"), p, 15), 16, 10).cast("decimal(38,0)") for p in (1, 16)]
    sums = df.select(row_hash(df).alias("_hash")).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").alias(f"_{i}") for i, p in enumerate(parts)])
    return sums.select("n_rows", F.substring(F.sha2(F.concat_ws(":", "n_rows", "_0", "_1"), 256), 1, 32).alias("fingerprint"))
