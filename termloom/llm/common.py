"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import work_folder

#: Text that one slice of an Arrow batch holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 20


#: Rows in a batch between Spark and Python; texts are long, and a batch is held on both sides.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the cluster's shared work folder: cuts the lineage."""
    path = f"{work_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, written, and marked for broadcast if there are no more than ``most``."""
    rows = written(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


#: The columns that tell documents apart.
IDENTITY = ["key", "text_hash", "text_hash2"]


def document_keys(docs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """``docs`` as (doc_id, key, text_hash, text_hash2, text), and the ``carried`` columns in a struct.

    ``IDENTITY`` tells documents apart even where doc_id repeats or is null;
    only rows that repeat both id and text share it.  The two hashes have 128
    bits in all, and each covers the key too: any number of rows may have one
    doc_id, and the hashes alone will do where no order by key is needed.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        key.alias("key"),
        F.xxhash64(key, text).alias("text_hash"),
        # What comes first seeds the hash of what follows.
        F.xxhash64(F.lit(1), key, text).alias("text_hash2"),
        text.alias("text"),
        *([F.struct(*carried).alias("carried")] if carried else []),
    )


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` (string or binary) holds about ``most`` bytes."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) as (node, component): the smallest node reached.

    Each round every node takes the smallest label among its neighbours and
    then its label's label, so chains shorten by half; rounds are written to
    the shared folder.  Nulls and loops are ignored.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = written(pairs.union(pairs.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(least, "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(
            step.join(jump, "next").select("node", F.least("next", "far").alias("new"), "label")
        )
        changed = not new.where(F.col("new") != F.col("label")).isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
