"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    v = v.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def half_precision(v: Column) -> Column:
    """What is left of a vector after 16-bit storage: 11 significant bits, rounded half to even, by expressions only.

    Below the normal range the steps stay the same; beyond the largest value comes infinity. Null components stay null.
    """

    def rounded(x: Column) -> Column:
        a = F.abs(x.cast("double"))
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(a)), F.lit(-14)) - 10)
        near = F.when(a >= 65520.0, float("inf")).otherwise(F.rint(a / step) * step)
        return F.when((a == 0) | F.isnan(x), x).otherwise(F.when(x < 0, -near).otherwise(near)).cast("float")

    return F.transform(v.cast("array<float>"), rounded)
