"""Vector expressions over ``ARRAY<FLOAT>`` columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_double(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either norm is 0, NULL when a vector is NULL.

    Vectors are expected to have equal length (see
    :func:`termloom.operators.vectors.check_dims`).
    """
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)
