"""Vector expressions on array columns. Products are summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this norm the runtime leaves a vector alone (the spacing of 32-bit floats at 1).
EPSILON = 1.1920928955078125e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column, epsilon: float = EPSILON) -> Column:
    """v over its norm; unchanged if the norm is below `epsilon`."""
    n = norm(v)
    return F.when(n < epsilon, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def truncate(v: Column, dim: int, epsilon: float = EPSILON) -> Column:
    """The first `dim` components, normalized again."""
    return normalize(F.slice(v, 1, dim), epsilon)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def close(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-4) -> Column:
    """All components within atol + rtol * |b|."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
