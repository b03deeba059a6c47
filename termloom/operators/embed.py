"""Embedding models as batch functions over a text column."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from typing import Protocol, runtime_checkable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed number of texts per call to a model.
TEXTS_PER_CALL = 100
VECTOR = pa.list_(pa.field("element", pa.float32()))


@runtime_checkable
class Embedder(Protocol):
    """What a model has to offer.

    ``embed`` returns one vector per text, in order.  A model may also have
    ``score(query, texts) -> list[float]``, which then replaces the cosine
    similarity in reranking, and ``embed_rows(rows, text, into, keep_failures)``,
    which then does the work of :func:`embed_texts`.
    """

    name: str
    dims: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def supports_scoring(embedder: object) -> bool:
    return callable(getattr(embedder, "score", None))


def embed_texts(
    rows: DataFrame,
    embedder: Embedder,
    text: str = "text",
    into: str = "embedding",
    keep_failures: bool = False,
) -> DataFrame:
    """Add the vector of ``text``; models see at most 100 texts per call.

    With ``keep_failures`` a failing call is repeated in halves, and the texts
    that fail by themselves get NULL vectors and a log line; otherwise it fails
    the job.  Columns other than ``text`` pass
    through untouched, so row order does not matter.

    A worker holds Spark's Arrow batches (10,000 rows or 64 MB by default) and, as
    Python objects, the texts of one call: batches are handed on in slices of a call.
    """
    if callable(getattr(embedder, "embed_rows", None)):
        return embedder.embed_rows(rows, text, into, keep_failures)
    at = rows.columns.index(text)
    schema = T.StructType(
        [*rows.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))]
    )

    def call(texts: list[str]) -> list:
        try:
            vectors = [list(map(float, v)) for v in embedder.embed(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{embedder.name}: {len(vectors)} vectors for {len(texts)} texts")
            return vectors
        except Exception as error:
            if not keep_failures:
                raise
            failure = error
        if len(texts) > 1:
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])
        logging.getLogger("termloom").info("no vector for a text: %s", failure)
        return [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = 0
            for start in range(0, batch.num_rows, TEXTS_PER_CALL):
                part = batch.slice(start, TEXTS_PER_CALL)
                vectors = call(part.column(at).to_pylist())
                missing += sum(v is None for v in vectors)
                made = pa.array(vectors, VECTOR, from_pandas=True)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, into])
            if missing:
                logging.getLogger("termloom").warning("%d of %d texts have no vector", missing, batch.num_rows)

    return rows.mapInArrow(run, schema)


def embed_queries(requests: DataFrame, embedder: Embedder) -> DataFrame:
    """(qid, query_embedding); NULL where the model failed."""
    texts = requests.select("qid", F.coalesce("q", F.lit("")).alias("text"))
    return embed_texts(texts, embedder, into="query_embedding", keep_failures=True).drop("text")


def score_pairs(pool: DataFrame, embedder, keys: Sequence[str]) -> DataFrame:
    """(qid, keys, ai_score) from a model that scores (query, texts) itself.

    Groups hold one query's candidate pool, at most twice its limit.
    """
    columns = ["qid", *keys]
    schema = T.StructType(
        [*[pool.schema[c] for c in columns], T.StructField("ai_score", T.DoubleType())]
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            scores = [float(s) for s in embedder.score(group["q"].iloc[0], group["text"].tolist())]
        except Exception:
            logging.getLogger("termloom").warning("scoring call failed", exc_info=True)
            return group[columns].head(0).assign(ai_score=pd.Series(dtype=float))
        return group[columns].assign(ai_score=scores)

    return pool.select(*columns, "q", "text").groupBy("qid").applyInPandas(run, schema)
