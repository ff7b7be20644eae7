"""Numeric expressions that behave alike on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def log10p1(x: Column) -> Column:
    return F.ln(x + 1) / F.ln(F.lit(10.0))


def six(x: Column) -> Column:
    """Rounded to six places, so that sums taken in another order compare equal."""
    return F.round(x.cast("double"), 6)


def when_sum(condition: Column, value: Column | float = 1.0) -> Column:
    """Sum of value over the rows where condition holds."""
    value = F.lit(value) if isinstance(value, int | float) else value
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def share_rounded(count: Column, per_mille: int) -> Column:
    """count * per_mille / 1000 rounded half up to a long: how a decimal product is cast to an integer."""
    return F.floor((count * per_mille + 500) / 1000).cast("long")


def kish(w: Column) -> Column:
    """Effective number of equal weights: (sum w)^2 / sum w^2."""
    return ratio(F.sum(w) * F.sum(w), F.sum(w * w))


def md5_order(*parts: Column | str) -> Column:
    """A hash to order and sample by that every engine can compute."""
    return F.md5(F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
