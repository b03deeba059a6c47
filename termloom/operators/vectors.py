"""Maintenance of a vector table ``(index_name, id, embedding)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_dims(dims: int, vector: str = "embedding") -> Column:
    """True for a vector of ``dims`` numbers, none of them missing."""
    column = F.col(vector)
    return F.coalesce(
        (F.size(column) == dims) & ~F.exists(column, lambda x: x.isNull()), F.lit(False)
    )


def keep_dims(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Batch form: rows of the wrong size are skipped."""
    return vectors.where(has_dims(dims, vector))


def rejected_dims(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """The rows that :func:`keep_dims` skips, with the size they came with."""
    return vectors.where(~has_dims(dims, vector)).withColumn(
        "actual_dims", F.coalesce(F.size(F.col(vector)), F.lit(0))
    )


def check_dims(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Strict form: the job fails on the first vector of the wrong size."""
    message = F.concat(
        F.lit(f"vector dimension mismatch: expected {dims}, got "),
        F.coalesce(F.size(F.col(vector)), F.lit(0)).cast("string"),
    )
    checked = F.when(has_dims(dims, vector), F.col(vector)).otherwise(F.raise_error(message))
    return vectors.withColumn(vector, checked)


def latest_vectors(
    history: DataFrame,
    order: Sequence[str],
    key: Sequence[str] = ("index_name", "id"),
    vector: str = "embedding",
) -> DataFrame:
    """One vector per key, the last in ``order`` wins.

    Each task keeps one candidate per key before the shuffle, so an id that was
    rewritten very often costs no more than any other.
    """
    return history.groupBy(*key).agg(F.max_by(vector, F.struct(*order)).alias(vector))


def delete_vectors(
    vectors: DataFrame, deleted: DataFrame, key: Sequence[str] = ("index_name", "id")
) -> DataFrame:
    return vectors.join(deleted.select(*key).distinct(), list(key), "left_anti")


def deleted_found(
    vectors: DataFrame, deleted: DataFrame, key: Sequence[str] = ("index_name", "id")
) -> DataFrame:
    """For each key to delete, whether a vector was there."""
    present = vectors.select(*key).distinct().withColumn("found", F.lit(True))
    return (
        deleted.select(*key)
        .distinct()
        .join(present, list(key), "left")
        .select(*key, F.coalesce("found", F.lit(False)).alias("deleted"))
    )


def vector_count(vectors: DataFrame) -> DataFrame:
    """(n, is_empty) of the live vectors."""
    return vectors.agg(F.count(F.lit(1)).alias("n")).withColumn("is_empty", F.col("n") == 0)
