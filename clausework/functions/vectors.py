"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(vec, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the common prefix."""
    return _sum(
        F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0.0 when a side is missing, empty or all zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))
    )


def search_score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)
