"""A cleaning pipeline over ``documents``, in stages that each read what the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from termloom.llm.catalog import RANKS, token_digests
from termloom.llm.common import IDENTITY, document_keys, small, small_batches, table
from termloom.session import work_folder

#: Contaminated documents whose keys are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from all labels, takes for toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go, and documents of which only blank text is left."""
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = line_dedup.dedup_lines(docs, carried=["doc_id", "text", *others])
    removed = F.size("removed")
    own = {
        "doc_id": F.col("carried.doc_id"),
        "text": F.when(removed == 0, F.col("carried.text")).otherwise(F.col("kept")),
        "n_chars": F.length(F.coalesce("kept", F.lit(""))).cast("long"),
    } | {c: F.col(f"carried.{c}") for c in others}
    left = rows.where((removed == 0) | F.col("kept").rlike(r"(?U)\S"))
    return left.select(*[own[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by shingle sets that are alike to 0.75 or more, that of least doc_id stays."""
    small_batches(spark)
    keys = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key")
    found = jaccard_join.jaccard_components(docs)
    stay = found.where("stays").select(keys, "text_hash", "text_hash2").distinct()
    rows = document_keys(docs, docs.columns).select(*IDENTITY, "carried")
    once = rows.join(stay, IDENTITY, "left_semi").dropDuplicates(IDENTITY)
    return once.select("carried.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or in pieces, go."""
    rows = document_keys(docs, docs.columns)
    hits = decontaminate.tiled_items(rows, table(spark, sf_dir, "benchmark"))
    bad = hits.where(F.col("covered") >= decontaminate.COVERAGE * F.col("words")).select(*IDENTITY).distinct()
    clean = rows.join(small(bad, BROADCAST_KEYS), IDENTITY, "left_anti")
    return clean.select("carried.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and their decoding, as digests."""
    small_batches(spark)
    vocab = byte_bpe.load_vocabulary(public_tokenizers.path(RANKS))
    return token_digests(docs.select("doc_id", "text"), vocab)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", token_ids),
]

#: SQL cannot express the learnt and the edit-distance stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others keep is written to the shared work folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
