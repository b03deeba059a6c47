"""Continuous ingest: every micro-batch of documents becomes one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.embed import Embedder
from termloom.sources.store import Store


def ingest_stream(
    store: Store,
    documents: DataFrame,
    name: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Start adding a stream of documents to ``store``.

    ``name`` identifies the stream in the commit log: a micro-batch that is
    replayed after a failure finds its commit there and is not added again, but
    the vectors that the failure may have cost are made.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        if store.stream_commit(name, batch_id) is None:
            store.add_documents(batch, embedder, stream=name, batch=batch_id)
        elif embedder is not None:
            store.fill_vectors(embedder)

    writer = documents.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
