"""Keyword, vector and hybrid retrieval over tables, built on Spark DataFrames."""

from termloom.operators.clauses import (
    clause_requests,
    compile_requests,
    match_all,
    phrase,
    term,
    term_range,
    term_set,
)
from termloom.operators.knn import knn
from termloom.operators.postings import scan_corpus
from termloom.plans.response import response
from termloom.plans.search import search
from termloom.sources.memo import EmbeddingMemo
from termloom.sources.store import Store
from termloom.streaming.ingest import ingest_stream
from termloom.streaming.search import search_stream

__all__ = [
    "EmbeddingMemo",
    "Store",
    "clause_requests",
    "compile_requests",
    "ingest_stream",
    "knn",
    "match_all",
    "phrase",
    "response",
    "scan_corpus",
    "search",
    "search_stream",
    "term",
    "term_range",
    "term_set",
]
