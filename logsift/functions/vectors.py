"""Vector columns: norm, unit length, cosine similarity of two array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def is_finite(vector: Column) -> Column:
    """Whether a vector has values and only finite ones; never null."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(plain & (F.size(vector) > 0), F.lit(False))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    length = F.when(norm(vector) == 0, F.lit(1.0)).otherwise(norm(vector))
    return F.transform(vector, lambda x: x.cast("double") / length)


def cosine(left: Column, right: Column) -> Column:
    """For pairs that are already on one row; joins use the blocked search instead."""
    return F.coalesce(F.try_divide(dot(left, right), norm(left) * norm(right)), F.lit(0.0))
