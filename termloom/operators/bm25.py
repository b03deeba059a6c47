"""BM25 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed BM25 parameters.
K1 = 1.2
B = 0.75


def idf(n_docs: Column | str, df: Column | str) -> Column:
    n = F.col(n_docs).cast("double") if isinstance(n_docs, str) else n_docs
    d = F.col(df).cast("double") if isinstance(df, str) else df
    return F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5))


def tf_weight(tf: Column | str, dl: Column | str, avgdl: Column | str) -> Column:
    """(k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / avgdl)); a field that is empty everywhere has length 0."""
    tf, dl, avgdl = (
        F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (tf, dl, avgdl)
    )
    avgdl = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return F.lit(K1 + 1.0) * tf / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * dl / avgdl))
