"""Reading document batches and bringing them to storage form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.schema import DEFAULT_INDEX


def _raw_documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(raw, item, reason): the text or element of each document, and why it cannot be one."""
    text = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    parsed = text.select("value", F.try_parse_json("value").alias("item"))
    if lines:
        items = parsed.select(F.col("value").alias("raw"), "item")
    else:
        several = F.try_variant_get("item", "$", "array<variant>")
        rows = parsed.select("value", F.explode_outer(F.coalesce(several, F.array("item"))).alias("item"))
        items = rows.select(F.coalesce(F.to_json("item"), F.col("value")).alias("raw"), "item")

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.variant_get("item", f"$.{name}", "variant"))

    def is_text(name: str, *others: str) -> Column:
        return F.coalesce(kind(name).isin("STRING", *others), F.lit(bool(others)))

    reason = (
        F.when(F.col("item").isNull(), "not JSON")
        .when(~F.schema_of_variant("item").startswith("OBJECT"), "not an object")
        .when(~is_text("title"), "title is not a string")
        .when(~is_text("body"), "body is not a string")
        .when(~is_text("id", "VOID"), "id is not a string")
        .when(~is_text("url", "VOID"), "url is not a string")
    )
    return items.select("raw", "item", reason.alias("reason"))


def _document(item: str) -> Column:
    fields = [F.try_variant_get(item, f"$.{n}", "string").alias(n) for n in ("id", "title", "body", "url")]
    metadata = F.variant_get(item, "$.metadata", "variant")
    return F.struct(*fields, F.when(~F.is_variant_null(metadata), metadata).alias("metadata"))


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents from JSON: arrays in whole files, or one document per line.

    Title and body must be strings, id and url strings or absent; anything else
    fails the job.  Keys other than the five document fields are ignored.
    Prefer ``lines`` for large inputs: one whole-file array is read by one task.
    """
    rows = _raw_documents(spark, path, lines)
    failure = F.raise_error(F.concat("reason", F.lit(": "), F.substring("raw", 1, 80)))
    checked = F.when(F.col("reason").isNull(), _document("item")).otherwise(failure)
    return rows.select(checked.alias("document")).select("document.*")


def read_documents_apart(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents that :func:`read_documents` takes, and (raw, reason) of the rest."""
    rows = _raw_documents(spark, path, lines)
    good = rows.where(F.col("reason").isNull()).select(_document("item").alias("document")).select("document.*")
    return good, rows.where(F.col("reason").isNotNull()).select("raw", "reason")


def fill_ids(docs: DataFrame) -> DataFrame:
    """Give documents with an absent or empty id a random UUID.

    The ids are new on every evaluation: write the result before using it twice.
    """
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    return docs.withColumn("id", F.when(blank, F.uuid()).otherwise(F.col("id")))


def _metadata_text(docs: DataFrame) -> Column:
    if "metadata" not in docs.columns:
        return F.lit("")
    kind = docs.schema["metadata"].dataType.typeName()
    column = F.col("metadata")
    return F.coalesce(column if kind == "string" else F.to_json(column), F.lit(""))


def to_storage(docs: DataFrame) -> DataFrame:
    """(index_name, id, title, body, url, metadata), absent url and metadata as ''."""
    index = (
        F.coalesce(F.col("index_name"), F.lit(DEFAULT_INDEX))
        if "index_name" in docs.columns
        else F.lit(DEFAULT_INDEX)
    )
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in docs.columns else F.lit("")
    return docs.select(
        index.alias("index_name"),
        "id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        url.alias("url"),
        _metadata_text(docs).alias("metadata"),
    )


def from_storage(stored: DataFrame) -> DataFrame:
    """Back to document form: empty url is NULL, empty or broken metadata is NULL."""
    return stored.withColumns(
        {
            "title": F.coalesce("title", F.lit("")),
            "body": F.coalesce("body", F.lit("")),
            "url": F.nullif("url", F.lit("")),
            "metadata": F.try_parse_json(F.nullif("metadata", F.lit(""))),
        }
    )
