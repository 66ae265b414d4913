"""Vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """dot(a,b) / (|a||b|); null when a vector is missing or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size > 0, size)
