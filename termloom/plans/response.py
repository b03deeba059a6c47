"""One response row per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.clauses import with_defaults


def response(requests: DataFrame, hits: DataFrame, ai_available: bool = False) -> DataFrame:
    """(qid, query, ai_enabled, hits) with hits in rank order.

    Requests without hits keep an empty array.  A group holds at most one
    request's limit.  Metadata is JSON text here, since a variant has no order.
    """
    entry = F.struct(
        "rank", "id", "title", "body", "url", "score", F.to_json("metadata").alias("metadata")
    )
    grouped = hits.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    shown = F.transform(
        F.coalesce("ranked", F.array()),
        lambda h: F.struct(
            *[h[c].alias(c) for c in ("id", "title", "body", "url", "score", "metadata")]
        ),
    )
    return (
        with_defaults(requests)
        .join(grouped, "qid", "left")
        .select(
            "qid",
            F.col("q").alias("query"),
            (F.col("ai") & F.lit(ai_available)).alias("ai_enabled"),
            shown.alias("hits"),
        )
    )
