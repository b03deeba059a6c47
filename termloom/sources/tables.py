"""Views of the given tables in the shapes the package works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import analyze
from termloom.schema import CLAUSE, CLAUSES


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread a file scan over the cores when it has fewer splits than there are cores.

    For plain scans only: it asks for the number of splits, which plans but does
    not run the query.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def corpus_documents(spark: SparkSession, folder: str, per_language: bool = False) -> DataFrame:
    """``documents`` as (index_name, doc_key, id, title, body, url, metadata).

    The title is the text before the first full stop; with ``per_language`` each
    language is an index of its own.
    """
    raw = spread(_read(spark, folder, "documents"), "doc_id")
    meta = F.to_json(F.struct("lang", "source"))
    return raw.select(
        (F.col("lang") if per_language else F.lit("default")).alias("index_name"),
        F.col("doc_id").alias("doc_key"),
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("url"),
        F.try_parse_json(meta).alias("metadata"),
    )


def web_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` as documents: title from the title tag, body with tags stripped."""
    raw = spread(_read(spark, folder, "pages"), "page_id")
    return raw.select(
        F.lit("web").alias("index_name"),
        F.col("page_id").alias("doc_key"),
        F.col("page_id").cast("string").alias("id"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_replace("html", r"<[^>]*>", " ").alias("body"),
        "url",
        F.lit(None).cast("variant").alias("metadata"),
    )


def vector_table(spark: SparkSession, folder: str, index_name: str = "default") -> DataFrame:
    raw = _read(spark, folder, "embeddings")
    return raw.select(
        F.lit(index_name).alias("index_name"),
        F.col("vec_id").cast("string").alias("id"),
        "embedding",
        "label",
    )


def benchmark_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per ``benchmark`` row, its text reduced to plain terms."""
    raw = _read(spark, folder, "benchmark")
    return raw.select(
        F.col("item_id").alias("qid"), F.array_join(analyze("text"), " ").alias("q")
    )


def short_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per ``benchmark`` row: its first three words and two that most documents have."""
    raw = _read(spark, folder, "benchmark")
    words = F.concat(F.slice(analyze("text"), 1, 3), F.array(F.lit("the"), F.lit("of")))
    return raw.select(F.col("item_id").alias("qid"), F.array_join(words, " ").alias("q"))


def benchmark_range_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per ``benchmark`` row: for each of its words, the body terms from it up to it and an "m"."""
    raw = _read(spark, folder, "benchmark")

    def clause(word):
        values = {
            "occur": F.lit("should"),
            "kind": F.lit("range"),
            "field": F.lit("body"),
            "lower": word,
            "upper": F.concat(word, F.lit("m")),
            "incl_lower": F.lit(True),
            "incl_upper": F.lit(False),
            "slop": F.lit(0),
            "boost": F.lit(1.0),
        }
        return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CLAUSE))

    words = F.array_distinct(analyze("text"))
    return raw.select(F.col("item_id").alias("qid"), F.transform(words, clause).cast(CLAUSES).alias("clauses"))


def user_turn_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per user turn of ``conversations``."""
    raw = _read(spark, folder, "conversations").where(F.col("role") == "user")
    return raw.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        F.array_join(analyze("text"), " ").alias("q"),
    )
