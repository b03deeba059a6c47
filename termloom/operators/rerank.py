"""Blend keyword scores with a semantic score, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.vector import cosine
from termloom.schema import SCORE_DIGITS

# Fixed value: the smallest range used when scaling, single-precision epsilon.
MIN_RANGE = 1.1920929e-7


def minmax(score: str, by: str = "qid") -> Column:
    """``score`` scaled to 0..1 within its query; 0 when all scores are equal."""
    window = Window.partitionBy(by)
    low, high = F.min(score).over(window), F.max(score).over(window)
    return (F.col(score) - low) / F.greatest(high - low, F.lit(MIN_RANGE))


def shifted(ai_score: str) -> Column:
    """A cosine moved from -1..1 to 0..1; a missing one counts as 0 and gives 0.5."""
    return (F.coalesce(F.col(ai_score), F.lit(0.0)) + 1.0) / 2.0


def semantic_scores(
    pool: DataFrame, vectors: DataFrame, query_vectors: DataFrame, few: bool = False
) -> DataFrame:
    """Add ``ai_score`` and ``has_query_vector`` to candidates (qid, index_name, id, ...).

    With ``few`` candidates (a checked number) their ids are broadcast to the
    vectors first, so only the vectors that are needed leave the scan.
    """
    stored = vectors.select("index_name", "id", "embedding")
    if few:
        ids = pool.select("index_name", "id").distinct()
        stored = stored.join(F.broadcast(ids), ["index_name", "id"], "left_semi")
    asked = query_vectors.select("qid", "query_embedding")
    joined = pool.join(stored, ["index_name", "id"], "left").join(asked, "qid", "left")
    return joined.withColumns(
        {
            "ai_score": cosine("query_embedding", "embedding"),
            "has_query_vector": F.col("query_embedding").isNotNull(),
        }
    ).drop("embedding", "query_embedding")


def fuse(candidates: DataFrame) -> DataFrame:
    """Final score and rank of candidates.

    Needs qid, bm25, bm25_rank, ai, ai_weight, ai_score and has_query_vector.  A
    query that did not ask for reranking, or whose vector is missing, keeps its
    keyword score and order.  Ties keep the keyword order.
    """
    weight = F.least(F.greatest(F.col("ai_weight"), F.lit(0.0)), F.lit(1.0))
    blended = (F.lit(1.0) - weight) * F.col("bm25_norm") + weight * F.col("ai_norm")
    reranked = F.col("ai") & F.col("has_query_vector")
    scored = candidates.withColumns(
        {"bm25_norm": minmax("bm25"), "ai_norm": shifted("ai_score")}
    ).withColumn(
        "score", F.when(reranked, F.round(blended, SCORE_DIGITS)).otherwise(F.col("bm25"))
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("bm25_rank"))
    return scored.withColumn("rank", F.row_number().over(order))
