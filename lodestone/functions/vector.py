"""Vector expressions over arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, places: int = 6) -> Column:
    """Cosine similarity, rounded; null where a vector is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(dot(a, b) / F.nullif(norms, F.lit(0.0)), places)
