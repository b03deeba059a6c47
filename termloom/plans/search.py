"""The whole retrieval pipeline as one DataFrame function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import candidate_text
from termloom.functions.vector import cosine
from termloom.operators.clauses import CompiledRequests, compile_requests
from termloom.operators.embed import Embedder, embed_queries, embed_texts, score_pairs, supports_scoring
from termloom.operators.match import BROADCAST_ROWS, fits_broadcast, keyword_pool
from termloom.operators.rerank import fuse, semantic_scores
from termloom.schema import OVERFETCH

# Candidate pools up to this many rows are settled before reranking.
SETTLED_ROWS = 50_000

HIT = ("qid", "index_name", "rank", "id", "title", "body", "url", "metadata", "score")


def search(
    corpus,
    requests: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    embedder: Embedder | None = None,
    max_results: int | None = None,
    embed_candidates: bool = False,
) -> DataFrame:
    """Ranked hits (qid, index_name, rank, id, title, body, url, metadata, score).

    Reranking needs query vectors (given, or made by ``embedder``) and stored
    ``vectors`` of the documents; with ``embed_candidates`` the candidates are
    embedded on the fly instead.  ``max_results`` lowers every request's limit.
    """
    if max_results is not None:
        if max_results < 1:
            raise ValueError("max_results must be at least 1")
        limit = F.col("limit") if "limit" in requests.columns else F.lit(None).cast("int")
        requests = requests.withColumn(
            "limit", F.least(F.coalesce(limit, F.lit(max_results)), F.lit(max_results))
        )
    compiled = compile_requests(requests)
    ranked = ranked_keys(corpus, compiled, vectors, query_vectors, embedder, embed_candidates)
    most = compiled.profile.queries * compiled.profile.max_limit
    return corpus.fetch(ranked, most).select(*HIT)


def ranked_keys(
    corpus,
    compiled: CompiledRequests,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    embedder: Embedder | None = None,
    embed_candidates: bool = False,
) -> DataFrame:
    """(qid, index_name, keys, score, rank) cut to each request's limit.

    Only keys and scores are ranked; stored fields are joined to the winners.
    """
    keys = list(corpus.keys)
    settings = compiled.requests.select("qid", "q", "limit", "ai", "ai_weight")
    small = fits_broadcast(compiled)
    settings = F.broadcast(settings) if small else settings
    pool = keyword_pool(corpus, compiled)
    rerank = can_rerank(vectors, query_vectors, embedder, embed_candidates)
    if rerank and _pool_rows(compiled) <= SETTLED_ROWS:
        # Reranking reads the pool several times: keys and scores of a small
        # one are computed once and kept as a local relation.
        pool = pool.sparkSession.createDataFrame(pool.toArrow())
    pool = pool.join(settings, "qid")
    if rerank:
        scored = _with_ai_scores(
            corpus, compiled, pool, vectors, query_vectors, embedder, embed_candidates
        )
        final = fuse(scored)
    else:
        final = pool.withColumns({"score": F.col("bm25"), "rank": F.col("bm25_rank")})
    return final.where(F.col("rank") <= F.col("limit")).select(
        "qid", "index_name", *keys, "score", "rank"
    )


def _pool_rows(compiled: CompiledRequests) -> int:
    """Most candidates a batch can have."""
    return compiled.profile.queries * compiled.profile.max_limit * OVERFETCH


def can_rerank(vectors, query_vectors, embedder, embed_candidates: bool) -> bool:
    has_queries = query_vectors is not None or embedder is not None
    has_documents = vectors is not None or embedder is not None and (
        embed_candidates or supports_scoring(embedder)
    )
    return has_queries and has_documents


def _with_ai_scores(
    corpus, compiled, pool, vectors, query_vectors, embedder, embed_candidates
) -> DataFrame:
    keys = list(corpus.keys)
    if embedder is not None and supports_scoring(embedder):
        texts = corpus.fetch(pool.where("ai")).withColumn("text", candidate_text())
        scores = score_pairs(texts, embedder, ["index_name", *keys])
        answered = scores.select("qid").distinct().withColumn("has_query_vector", F.lit(True))
        return (
            pool.join(scores, ["qid", "index_name", *keys], "left")
            .join(answered, "qid", "left")
            .fillna(False, ["has_query_vector"])
        )
    if query_vectors is None:
        query_vectors = embed_queries(compiled.requests.where("ai"), embedder)
    if embed_candidates:
        # Each candidate is embedded once, however many queries want it.
        wanted = pool.where("ai").select("index_name", *keys).distinct()
        texts = corpus.fetch(wanted).select("index_name", *keys, candidate_text().alias("text"))
        made = embed_texts(texts, embedder, keep_failures=True).drop("text")
        asked = query_vectors.select("qid", "query_embedding")
        # One candidate without a vector, and the whole query keeps its keyword order.
        complete = F.min(F.col("embedding").isNotNull()).over(Window.partitionBy("qid"))
        return (
            pool.join(made, ["index_name", *keys], "left")
            .join(asked, "qid", "left")
            .withColumns(
                {
                    "ai_score": cosine("query_embedding", "embedding"),
                    "has_query_vector": F.col("query_embedding").isNotNull() & complete,
                }
            )
            .drop("embedding", "query_embedding")
        )
    ids = corpus.fetch_ids(pool)
    few = _pool_rows(compiled) <= BROADCAST_ROWS
    return semantic_scores(ids, vectors, query_vectors, few=few)
