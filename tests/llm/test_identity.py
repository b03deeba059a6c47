"""Different texts under one id whose 32-bit hashes are equal."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import decontaminate, jaccard_join, line_dedup, repeats
from termloom.llm.common import IDENTITY, document_keys

SCHEMA = "doc_id long, text string"


def passage(letter: str) -> str:
    return " ".join(f"{letter}{n:02d}" for n in range(60))


A, B = f"{passage('a')} 00103436", f"{passage('b')} 00086488"


@pytest.fixture(params=[5, None])
def docs(spark, request):
    rows = spark.createDataFrame([(request.param, A), (request.param, B)], SCHEMA)
    assert rows.select(F.hash("text")).distinct().count() == 1
    return rows


def test_keys(docs):
    assert document_keys(docs).select(IDENTITY).distinct().count() == 2


def test_neither_is_cut_by_what_the_other_repeats(spark, docs):
    rows = docs.union(spark.createDataFrame([(-(2**62), A)], SCHEMA))
    cut = {bytes(r.kept) for r in repeats.remove_repeats(rows).collect() if bytes(r.kept)}
    assert cut == {B.encode()}
    kept = [r.kept for r in line_dedup.dedup_lines(rows).collect()]
    assert sorted(kept) == ["", A, B]


def test_leaks_and_near_copies(spark, docs, tmp_path):
    spark.createDataFrame([(1, passage("a"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = docs.select("doc_id", "text")
    assert [r.text for r in corpus_pipeline.drop_leaks(spark, full, str(tmp_path)).collect()] == [B]
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert sorted(r.contaminated for r in hits.collect()) == [False, True]
    assert sorted(r.text for r in corpus_pipeline.drop_near_copies(spark, full, str(tmp_path)).collect()) == [A, B]


def test_representatives_meet_their_own_texts_only(spark):
    docs = document_keys(spark.createDataFrame([(None, f"text {n}") for n in range(30)], SCHEMA))
    reps = docs.select(*IDENTITY, F.col("text_hash").alias("sig1"), F.col("text_hash2").alias("sig2"))
    assert jaccard_join._texts_of(docs, reps).count() == 30
