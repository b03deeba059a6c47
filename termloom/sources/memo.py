"""Vectors kept by the digest of their text, so that a model sees each text once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.embed import Embedder, embed_texts, supports_scoring
from termloom.session import scratch_table
from termloom.sources.store import LITERAL_TERMS, one_of

# Digests up to this count make a Bloom filter (16 bits each at most, 40 MB in all);
# more are joined without one.
FILTER_KEYS = 20_000_000
# Fixed values of the filter: places per digest, and bits of one bitmap of Spark's.
PLACES = 7
BITMAP_BITS = 32_768

DIGEST = "__text_digest"
_ROW = "digest STRING, embedding ARRAY<FLOAT>"


def text_digest(text: str | Column) -> Column:
    """SHA-256 of a text, null as the empty one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _places(digest: str, bits: int) -> tuple[Column, Column]:
    """Start and step of a digest's places among ``bits``."""
    start, step = (F.pmod(F.xxhash64(F.lit(i), digest), F.lit(bits)) for i in (0, 1))
    return start, step.bitwiseOR(F.lit(1).cast("long"))


def bloom_filter(digests: DataFrame, count: int) -> Column:
    """A condition that holds for all ``digests`` (digest; ``count`` rows) and for about 1 % of others.

    The bits are set in the executors, bitmap by bitmap; what reaches the driver
    and is broadcast has the size of the filter.
    """
    bits = max(BITMAP_BITS, 1 << (10 * count - 1).bit_length())
    start, step = _places("digest", bits)
    place = F.pmod(F.col("start") + F.col("i") * F.col("step"), F.lit(bits)) + 1  # Spark counts from 1
    rows = digests.select(start.alias("start"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("i"))
    maps = (
        rows.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
        .toArrow()
    )
    table = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for bucket, bitmap in zip(maps["bucket"].to_pylist(), maps["bitmap"].to_pylist()):
        table[bucket - 1] = np.frombuffer(bitmap, np.uint8)
    shared = digests.sparkSession.sparkContext.broadcast(table.reshape(-1))

    @F.pandas_udf("boolean")
    def among(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held = shared.value
        for start, step in batches:
            start, step = start.to_numpy(np.int64), step.to_numpy(np.int64)
            found = np.ones(len(start), bool)
            for i in range(PLACES):
                place = (start + i * step) % bits
                found &= (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            yield pd.Series(found)

    return among(*_places("digest", bits))


class EmbeddingMemo:
    """A model that remembers: pass it wherever a model is taken.

    ``root`` is a folder that all executors reach; the vectors of each model, by
    name and size, lie there in a table (digest, embedding), sorted by digest
    within files.  Documents, commits and requests that use the same folder share
    it: a text is embedded the first time that anything asks for it, and once,
    however many rows hold it.  Texts that the model fails on are not kept, and
    are tried again.

    The table is only added to, and each row stands for itself: what a lost job
    left behind is as good as the rest.  Writers at the same time may embed a
    text twice; readers take one row.
    """

    def __init__(self, embedder: Embedder, root: str):
        self.embedder = embedder
        self.name, self.dims = embedder.name, embedder.dims
        model = hashlib.sha256(f"{self.dims}:{self.name}".encode()).hexdigest()[:16]
        self.path = f"{root.rstrip('/')}/{model}"
        if supports_scoring(embedder):
            self.score = embedder.score

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """The model's own vectors, without the memo."""
        return self.embedder.embed(texts)

    def table(self, spark: SparkSession) -> DataFrame:
        """(digest, embedding) of all that is kept."""
        spark.createDataFrame([], _ROW).write.mode("ignore").parquet(f"{self.path}/added=first")
        return spark.read.schema(_ROW).parquet(self.path).select("digest", "embedding")

    def known(self, digests: DataFrame, count: int) -> DataFrame:
        """(digest, embedding) of those of ``digests`` (digest, each once; ``count`` rows) that are kept.

        Few digests are literals, by which Parquet skips data.  More become a Bloom
        filter, so that of the table only what is asked for, and about 1 % of the
        rest, is shuffled.
        """
        rows = self.table(digests.sparkSession)
        if count <= LITERAL_TERMS:
            rows = rows.where(one_of("digest", [row["digest"] for row in digests.collect()]))
        elif count <= FILTER_KEYS:
            rows = rows.where(bloom_filter(digests, count))
        return rows.join(digests, "digest", "left_semi").dropDuplicates(["digest"])

    def embed_rows(self, rows: DataFrame, text: str, into: str, keep_failures: bool) -> DataFrame:
        """As :func:`embed_texts`, by the memo; null texts are taken as empty.

        Digests are looked up first: only texts that are new are shuffled, and
        equal ones are combined where they are read.
        """
        spark = rows.sparkSession
        marked = rows.withColumn(DIGEST, text_digest(text))
        digests = scratch_table(marked.select(F.col(DIGEST).alias("digest")).distinct())
        known = scratch_table(self.known(digests, digests.count()))
        new = digests.join(known.select("digest"), "digest", "left_anti")
        texts = (
            marked.select(F.col(DIGEST).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
            .join(new, "digest", "left_semi")
            .groupBy("digest")
            .agg(F.first("text").alias("text"))
        )
        made = embed_texts(texts, self.embedder, keep_failures=keep_failures).select("digest", "embedding")
        added = f"{self.path}/added={uuid.uuid4().hex}"
        kept = made.where(F.col("embedding").isNotNull()).sortWithinPartitions("digest")
        kept.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(added)
        fresh = spark.read.schema(_ROW).parquet(added)
        vectors = known.unionByName(fresh).select(F.col("digest").alias(DIGEST), F.col("embedding").alias(into))
        return marked.join(vectors, DIGEST, "left").select(*rows.columns, into)
