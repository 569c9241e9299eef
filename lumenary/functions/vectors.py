"""Vector expressions over arrays; arithmetic in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ or either is null."""
    total = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def normalise(v: Column) -> Column:
    """Null for a zero vector. The vector and its norm are bound by arrays of one, so that neither is worked out anew for each component."""
    over = lambda d: F.transform(F.array(norm(d)), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)))[0]
    return F.transform(F.array(_doubles(v)), over)[0]


def finite(v: Column) -> Column:
    return F.forall(_doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def unit(v: Column, tolerance: float = 2e-6) -> Column:
    return finite(v) & (F.abs(norm(v) - 1) <= tolerance)
