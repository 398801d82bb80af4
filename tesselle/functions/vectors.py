"""Vector arithmetic on arrays of numbers, in double precision, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def usable(a: Column, dim: int) -> Column:
    """Right size, finite and not all zero."""
    return (F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & F.exists(a, lambda x: x != 0)
