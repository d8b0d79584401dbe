"""Functions on array columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.scalar import col


def doubles(v) -> Column:
    return col(v).cast("array<double>")


def sanitize(v) -> Column:
    return F.transform(doubles(v), lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(F.coalesce(x, F.lit(0.0))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, not once for each element of a lambda in body."""
    return F.transform(F.array(value), body)[0]


def unit(v) -> Column:
    """The row over its length; rows shorter than 1e-12 stay."""
    over = lambda s, n: F.transform(s, lambda x: x / F.when(n <= 1e-12, 1.0).otherwise(n))
    return let(sanitize(v), lambda s: let(norm(s), lambda n: over(s, n)))


def subtract(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def cosine_residual(y, y_hat) -> Column:
    n = norm(y) * norm(y_hat)
    return F.when((norm(y) == 0) & (norm(y_hat) == 0), 0.0).when(n == 0, 1.0).otherwise(1 - F.least(F.greatest(dot(y, y_hat) / n, F.lit(-1.0)), F.lit(1.0)))


def angle(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.acos(F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0)))


def coordinate(v, i: int) -> Column:
    """The i-th component from 1; 0 beyond the end."""
    return F.coalesce(F.get(sanitize(v), F.lit(i - 1)), F.lit(0.0))
