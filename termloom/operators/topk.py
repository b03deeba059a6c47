"""Best k rows per group, with the cut done before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    per_row_limit: Column | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows of each group, numbered from 1 in ``rank``.

    ``k`` is a literal, which lets Spark cut each partition to ``k`` rows per
    group before it shuffles.  ``per_row_limit`` can only narrow it further.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    if per_row_limit is not None:
        ranked = ranked.where(F.col(rank) <= per_row_limit)
    return ranked
