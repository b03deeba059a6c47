"""Continuous search: every micro-batch of requests runs on the newest snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.search import search
from termloom.sources.store import Store


def search_stream(
    store: Store,
    requests: DataFrame,
    output: str,
    checkpoint: str,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Start answering a stream of requests; hits go to Parquet under ``output``.

    A micro-batch writes one directory, and replaces it when it is replayed.
    ``options`` are those of :func:`termloom.plans.search.search`.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        snapshot = store.snapshot()
        hits = search(snapshot, batch, **options)
        hits.withColumns(
            {"metadata": F.to_json("metadata"), "commit_seq": F.lit(snapshot.seq).cast("bigint")}
        ).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
