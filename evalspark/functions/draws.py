"""Random draws that depend on nothing but what is drawn: numbers of Poisson distributions from hashes.

A cell (rows that are alike) has a tag; a draw of the cell is the hash of the tag and the draw's number. So draws do not
change with the partitioning, after a lost task or on another engine, and need no state and no Python.

The rows of a cell of ``n`` rows are drawn Poisson(n) times: the sum of independent Poisson(2^k) for the low bits of n,
each by inverting its distribution (``DIGITS`` hexadecimal digits of the hash), and of one number for the rest of n, 32
or more, by the normal quantile with its first correction for skewness.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, DIGITS = 5, 5
NORMAL_DIGITS = 7  # of each of two numbers
_FINE = 2.0**62


def inverse_poisson(mean: int, digits: int = DIGITS) -> list[str]:
    """``t[j]`` in hexadecimal: a uniform number below it, and not below ``t[j - 1]``, draws ``j``; the last one + 1 is
    drawn above all."""
    out, term, total, j = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        at = math.floor(total * 16**digits)
        if at >= 16**digits - 1:
            return out
        out.append(f"{at:0{digits}x}")
        j += 1
        term *= mean / j


_TABLES = [inverse_poisson(1 << k) for k in range(BITS)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def score_text(score: Column) -> Column:
    """A score as text, the same on every engine: its whole part, and its fraction in 62 binary places."""
    whole = F.floor(F.least(F.greatest(score, F.lit(-1e15)), F.lit(1e15)))
    fine = F.floor((score - F.floor(score)) * F.lit(_FINE))
    return F.concat_ws(".", whole.cast("bigint").cast("string"), F.when(F.abs(score) < 1e15, fine.cast("bigint")).otherwise(F.lit(0)).cast("string"))


def cell_tag(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw_hash(tag: Column, draw: Column) -> Column:
    return F.sha1(F.concat(tag, F.lit("|"), draw.cast("string")))


def _digits(hash_: Column, k: int) -> Column:
    return F.substring(hash_, 1 + DIGITS * k, DIGITS)


def _normal(hash_: Column) -> Column:
    a, b = (F.conv(F.substring(hash_, 1 + DIGITS * BITS + NORMAL_DIGITS * i, NORMAL_DIGITS), 16, 10).cast("double") for i in (0, 1))
    size = float(16**NORMAL_DIGITS)
    return F.sqrt(F.lit(-2.0) * F.log((a + 1) / size)) * F.cos(F.lit(2 * math.pi) * b / size)


def _drawn(n: Column, digits: list[Column], normal: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for k in range(BITS):
        number = None
        for j, t in enumerate(_TABLES[k]):
            below = digits[k] < t
            number = F.when(below, j) if number is None else number.when(below, j)
        total = total + F.when(n.bitwiseAND(F.lit(1 << k)) != 0, number.otherwise(len(_TABLES[k]))).otherwise(0)
    mean = (n - n.bitwiseAND(F.lit((1 << BITS) - 1))).cast("double")
    rest = F.floor(mean + F.sqrt(mean) * normal + (normal * normal - 1) / 6 + F.lit(0.5))
    return total + F.when(n >= 1 << BITS, F.greatest(rest, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def poisson(n: Column, hash_: Column) -> Column:
    """Poisson(n) as one expression, for small tables; ``with_draws`` is the form for many rows."""
    return let(hash_, lambda h: let(_normal(h), lambda z: _drawn(n, [_digits(h, k) for k in range(BITS)], z)))


def with_draws(cells: DataFrame, draws: int, count: str, tag: str) -> DataFrame:
    """Every cell once for each draw: (``draw``, ``weight``) beside its columns, inside compiled stages."""
    out = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_hash", draw_hash(F.col(tag), F.col("draw")))
    names = [f"_digits{k}" for k in range(BITS)]
    normal = F.when(F.col(count) >= 1 << BITS, _normal(F.col("_hash"))).otherwise(0.0)
    out = out.select("*", *[_digits(F.col("_hash"), k).alias(c) for k, c in enumerate(names)], normal.alias("_normal"))
    return out.withColumn("weight", _drawn(F.col(count), [F.col(c) for c in names], F.col("_normal"))).drop("_hash", "_normal", *names)
