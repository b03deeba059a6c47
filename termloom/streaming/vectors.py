"""Upserts and deletes of vectors that arrive as a stream, the last in order wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.vectors import has_dims

KEY = ("index_name", "id")


def last_changes(changes: DataFrame, order: Sequence[str], dims: int, key: Sequence[str] = KEY) -> DataFrame:
    """(*key, deleted, embedding): the last change of each key in ``order``, whenever it arrived.

    ``changes`` has ``key``, ``order``, ``embedding`` and ``deleted`` (null: false).
    On a stream the state of a key is its last change; deletes stay in it, so
    that an older upsert that comes late does not bring the vector back.  A
    repeated row changes nothing.  Of changes of equal order a delete wins, then
    the greater vector.  Upserts of other than ``dims`` numbers are skipped.
    """
    gone = F.coalesce("deleted", F.lit(False))
    rows = changes.withColumn("deleted", gone).where(F.col("deleted") | has_dims(dims))
    vector = F.when(~F.col("deleted"), F.col("embedding")).alias("embedding")
    last = rows.groupBy(*key).agg(F.max(F.struct(F.struct(*order), "deleted", vector)).alias("last"))
    return last.select(*key, "last.deleted", "last.embedding")


def publish_stream(last: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the keys that each micro-batch touched, with their last change, to the table ``target``.

    A replayed batch writes its own partition again.  Keep the state in RocksDB
    where there are more keys than executors have memory for.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = last.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_vectors(published: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(*key, embedding) of the live vectors, of the table that :func:`publish_stream` writes.

    A key's newest partition has its last change: the history of changes is not read.
    """
    last = published.groupBy(*key).agg(F.max(F.struct("batch", "deleted", "embedding")).alias("last"))
    return last.where(~F.col("last.deleted")).select(*key, "last.embedding")
