"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components of the vectors that the engine makes itself.
DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; a missing or zero vector scores 0."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))
