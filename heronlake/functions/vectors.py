"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def valid(v: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and only finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dimension) & ~bad


def half(v: Column) -> Column:
    """A vector whose numbers are rounded to half precision (11 bits of mantissa, ties to even; beyond the largest they are infinite), as doubles."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        size = F.abs(x)
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(-14)) - 10)
        near = F.rint(x / step) * step
        return F.when(F.abs(near) > 65504.0, F.signum(x) * float("inf")).otherwise(near)

    return F.transform(v, one)
