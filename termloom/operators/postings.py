"""Postings and corpus statistics derived from a documents table.

A posting row is ``(index_name, *keys, field, term, tf, dl[, positions])``.
Every document also has one marker posting per field (term ``''``, tf 1) that
carries the field length ``dl``: counting markers gives the number of documents
and summing their ``dl`` gives the number of tokens, zero-length fields
included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import is_indexed_token, raw_tokens
from termloom.operators.clauses import DOC_MARKER, TERM_KEY, CompiledRequests
from termloom.schema import DEFAULT_FIELDS
from termloom.session import repartitioned, scratch_table, text_partitions


def token_rows(
    docs: DataFrame, keys: Sequence[str], fields: Sequence[str] = DEFAULT_FIELDS
) -> DataFrame:
    """One row per token, plus one marker row per document and field.

    Columns: index_name, keys, field, term, pos, dl.  The position counts every
    token of the field, so a dropped long token leaves a gap.
    """
    head = ["index_name", *keys]
    per_field = [
        F.struct(F.lit(name).alias("field"), F.coalesce(F.col(name), F.lit("")).alias("text"))
        for name in fields
    ]
    whole = F.col("field") == "id"
    texts = docs.select(*head, F.inline(F.array(*per_field)))
    tokenized = texts.select(
        *head,
        "field",
        F.when(whole, F.array("text")).otherwise(raw_tokens("text")).alias("tokens"),
    )
    measured = tokenized.select(
        *head,
        "field",
        "tokens",
        F.when(whole, F.lit(1))
        .otherwise(F.size(F.filter("tokens", is_indexed_token)))
        .alias("dl"),
    )
    exploded = measured.select(
        *head,
        "field",
        "dl",
        F.posexplode(F.concat(F.array(F.lit(DOC_MARKER)), F.col("tokens"))).alias("n", "token"),
    ).where(whole | is_indexed_token("token"))
    return exploded.select(
        *head,
        "field",
        F.when(whole, F.col("token")).otherwise(F.lower("token")).alias("term"),
        (F.col("n") - 1).alias("pos"),
        "dl",
    )


def term_rows(docs: DataFrame, keys: Sequence[str], fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    """(index_name, keys, field, term): each term of a document and field once, without markers."""
    head = ["index_name", *keys]

    def terms(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        if name == "id":
            return F.array(text)
        kept = F.filter(raw_tokens(text), is_indexed_token)
        return F.array_distinct(F.transform(kept, lambda t: F.lower(t)))

    per_field = [F.struct(F.lit(name).alias("field"), terms(name).alias("terms")) for name in fields]
    return docs.select(*head, F.inline(F.array(*per_field))).select(*head, "field", F.explode("terms").alias("term"))


def group_tokens(tokens: DataFrame, keys: Sequence[str], positions: bool) -> DataFrame:
    aggregates = [F.count(F.lit(1)).cast("int").alias("tf")]
    if positions:
        aggregates.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return tokens.groupBy("index_name", *keys, "field", "term", "dl").agg(*aggregates)


def build_postings(
    docs: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str] = DEFAULT_FIELDS,
    positions: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """All postings of ``docs``, with the text shuffled once and nothing after it.

    Documents move by their key before they are split into tokens: text is
    smaller than its postings, and grouping by (key, field, term) then needs no
    exchange.  Without ``partitions`` the text is measured first, so that what
    a task groups does not grow with the input.
    """
    spread = repartitioned(docs, partitions or text_partitions(docs, fields), *keys)
    return group_tokens(token_rows(spread, keys, fields), keys, positions)


def term_statistics(postings: DataFrame) -> DataFrame:
    """(index_name, field, term, df, tokens) with the marker rows kept.

    On marker rows ``df`` is the number of documents and ``tokens`` their total
    length.
    """
    return postings.groupBy(*TERM_KEY).agg(
        F.count(F.lit(1)).alias("df"),
        F.sum(F.when(F.col("term") == DOC_MARKER, F.col("dl")).otherwise(F.col("tf")))
        .cast("long")
        .alias("tokens"),
    )


def field_statistics(stats: DataFrame) -> DataFrame:
    """(index_name, field, n_docs, n_tokens, avgdl) from the marker rows."""
    return (
        stats.where(F.col("term") == DOC_MARKER)
        .select(
            "index_name",
            "field",
            F.col("df").alias("n_docs"),
            F.col("tokens").alias("n_tokens"),
            (F.col("tokens").cast("double") / F.col("df")).alias("avgdl"),
        )
    )


def with_field_totals(stats: DataFrame, few: bool = True) -> DataFrame:
    """Add n_docs and avgdl of the field to each term row.

    With ``few`` rows, a checked number of query terms, a window over each field
    reads ``stats`` once.  Otherwise the totals are joined on.
    """
    if not few:
        totals = field_statistics(stats).select("index_name", "field", "n_docs", "avgdl")
        return stats.select(*TERM_KEY, "df").join(totals, ["index_name", "field"])
    window = Window.partitionBy("index_name", "field")
    marker = F.col("term") == DOC_MARKER

    def total(column: str) -> Column:
        return F.max(F.when(marker, F.col(column))).over(window)

    return stats.select(
        *TERM_KEY,
        "df",
        total("df").alias("n_docs"),
        (total("tokens").cast("double") / total("df")).alias("avgdl"),
    )


def documents_view(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents with every column the search pipeline needs."""
    missing = {
        "index_name": F.lit("default"),
        "url": F.lit(None).cast("string"),
        "metadata": F.lit(None).cast("variant"),
    }
    out = docs
    for name, value in missing.items():
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out.select("index_name", *keys, "id", "title", "body", "url", "metadata")


@dataclass(frozen=True)
class ScanCorpus:
    """A documents table searched without a stored index.

    ``keys`` name the columns that identify a row; ids may repeat, keys not.
    Each search reads the text once for the terms it asks for.
    """

    documents: DataFrame
    keys: tuple[str, ...] = ("doc_key",)

    @cached_property
    def partitions(self) -> int | None:
        """Partitions for what is shuffled by document key, as :func:`text_partitions`."""
        return text_partitions(self.documents, DEFAULT_FIELDS)

    def postings_for(self, compiled: CompiledRequests, broadcast: bool = True) -> DataFrame:
        """Postings of the wanted terms, markers included.

        Tokens are matched before they are shuffled, and they are shuffled by
        document key, so that scoring needs no second exchange.
        """
        tokens = token_rows(self.documents, self.keys, compiled.profile.fields)
        wanted = F.broadcast(compiled.wanted) if broadcast else compiled.wanted
        matched = tokens.join(wanted, list(TERM_KEY), "left_semi")
        positions = compiled.profile.any_phrase
        if not positions:
            matched = matched.drop("pos")
        matched = repartitioned(matched, self.partitions, *self.keys)
        return group_tokens(matched, self.keys, positions)

    def statistics_for(self, compiled: CompiledRequests, postings: DataFrame) -> DataFrame:
        """df and totals of the wanted terms, from the same exchange as the postings."""
        return term_statistics(postings)

    def postings_between(self, condition: Column, fields: Sequence[str]) -> DataFrame:
        """Postings (index_name, keys, field, term) whose field and term meet ``condition``."""
        return term_rows(self.documents, self.keys, fields).where(condition)

    def terms_between(self, condition: Column, fields: Sequence[str]) -> DataFrame:
        """Distinct (index_name, field, term) that meet ``condition``."""
        return self.postings_between(condition, fields).select(*TERM_KEY).distinct()

    def settled(self, postings: DataFrame) -> DataFrame:
        """``postings`` for more than one reading, without tokenizing the text again."""
        return scratch_table(postings)

    def document_count(self) -> int:
        return self.documents.count()

    def fetch(self, hits: DataFrame, rows: int | None = None) -> DataFrame:
        """Join stored fields onto ranked hits."""
        return hits.join(self.documents, ["index_name", *self.keys])

    def fetch_ids(self, hits: DataFrame) -> DataFrame:
        """Join only the document id onto ranked hits."""
        ids = self.documents.select("index_name", *self.keys, "id")
        return hits.join(ids, ["index_name", *self.keys])


def scan_corpus(docs: DataFrame, keys: Sequence[str] = ("doc_key",)) -> ScanCorpus:
    return ScanCorpus(documents_view(docs, keys), tuple(keys))
