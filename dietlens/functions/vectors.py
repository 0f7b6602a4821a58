"""Vector functions over `array<float>` or `array<double>` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dietlens.functions.text import as_column


def _doubles(vector: Column | str) -> Column:
    return as_column(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def total(vector: Column | str) -> Column:
    return F.aggregate(_doubles(vector), F.lit(0.0), lambda t, x: t + x)


def l2_norm(vector: Column | str) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = l2_norm(vector)
    return F.transform(_doubles(vector), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, F.lit(1.0) - dot(a, b) / norms).otherwise(F.lit(1.0))


def similarity_from_distance(distance: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - as_column(distance)))
