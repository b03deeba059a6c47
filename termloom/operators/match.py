"""Evaluate compiled requests against a corpus and score the matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.blocks import block_scores, packed_documents, passes_scores
from termloom.operators.bm25 import idf, tf_weight
from termloom.operators.clauses import (
    DOC_MARKER,
    MASK_CLAUSES,
    TERM_KEY,
    CompiledRequests,
    clause_bit,
)
from termloom.operators.postings import with_field_totals
from termloom.operators.pruning import pruned_scores
from termloom.operators.ranges import range_matches
from termloom.operators.topk import top_k
from termloom.schema import OVERFETCH, SCORE_DIGITS
from termloom.session import scratch_table

# A query-side table is broadcast only when the request profile shows that it
# stays below these sizes; larger ones use a salted shuffle join.
BROADCAST_ROWS = 500_000
BROADCAST_TEXT_BYTES = 64 * 1024 * 1024
SALTS = 32
# From this many words in a batch on, each counted once for a field, requests are scored in blocks.
BLOCK_TERMS = 15_000


def fits_broadcast(compiled: CompiledRequests) -> bool:
    profile = compiled.profile
    return profile.term_rows <= BROADCAST_ROWS and profile.text_bytes <= BROADCAST_TEXT_BYTES


def join_queries(
    postings: DataFrame, queries: DataFrame, keys, small: bool, on: Sequence[str] = TERM_KEY
) -> DataFrame:
    """Join postings with query rows, on (index_name, field, term) unless told otherwise.

    The large form spreads each term over ``SALTS`` groups by document key, as a
    frequent term may hold a large share of all postings.
    """
    if small:
        return postings.join(F.broadcast(queries), list(on))
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
    spread = postings.withColumn("salt", salt)
    copies = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The copies compress so well that Spark may take them for a table that can be broadcast.
    return spread.join(copies.hint("merge"), [*on, "salt"]).drop("salt")


def fan_out(postings: DataFrame, queries: DataFrame, keys, small: bool) -> DataFrame:
    """As :func:`join_queries`, for terms that many queries share.

    The small form keeps the queries of a term together in one array, which is
    read in order instead of row by row from a hash chain.
    """
    if not small:
        return join_queries(postings, queries, keys, small)
    rest = [c for c in queries.columns if c not in TERM_KEY]
    packed = queries.groupBy(*TERM_KEY).agg(F.collect_list(F.struct(*rest)).alias("asks"))
    joined = postings.join(F.broadcast(packed), list(TERM_KEY))
    return joined.select(*postings.columns, F.inline("asks"))


def valued_postings(postings: DataFrame, weights: DataFrame, keys, small: bool) -> DataFrame:
    """(index_name, field, term, keys, worth): what a posting is worth to any query.

    That does not depend on the query, so it is computed before the postings
    fan out to the queries that ask for their term.
    """
    return join_queries(postings, weights, keys, small).select(*TERM_KEY, *keys, _worth())


def _worth() -> Column:
    return (idf("n_docs", "df") * tf_weight("tf", "dl", "avgdl")).alias("worth")


def _term_scores(compiled, postings, weights, keys, small) -> DataFrame:
    """One row per (query, document, clause, field) with its BM25 or constant score."""
    valued = valued_postings(postings, weights, keys, small)
    score = F.col("boost") * F.col("worth")
    terms = compiled.terms
    if compiled.profile.plain:
        terms = terms.select("qid", *TERM_KEY, "boost")
        asked = fan_out(valued, terms, keys, small)
        return asked.select("qid", *keys, score.alias("score"))
    score = F.when(F.col("kind") == "term", score).otherwise(F.col("boost"))
    out = fan_out(valued, terms, keys, small).withColumn("score", score)
    if not compiled.profile.any_set:
        return out.select(*_contribution(keys))
    # A set clause counts once per field however many of its terms are present.
    once = F.when(F.col("kind") == "set", F.lit("")).otherwise(F.col("term"))
    grouped = out.groupBy(
        "qid", *keys, "required", "clause_id", "occur", "field", once.alias("once")
    ).agg(F.max("score").alias("score"))
    return grouped.select(*_contribution(keys))


def _contribution(keys) -> list[str]:
    return ["qid", *keys, "required", "clause_id", "occur", "score"]


def phrase_frequency(slots: Column, slop: Column) -> Column:
    """How often a phrase occurs, from its terms' shifted positions.

    ``slots`` is an array, in phrase order, of position arrays from which the
    term's place in the phrase has been subtracted, so an exact phrase has the
    same value in every slot.  Level ``c`` of the accumulator holds the
    positions reachable with a total displacement of exactly ``c``; the work is
    linear in the number of positions.
    """
    levels = F.sequence(F.lit(0), slop)
    none = F.array().cast("array<int>")
    start = F.transform(levels, lambda c: F.when(c == 0, F.get(slots, 0)).otherwise(none))

    def step(acc: Column, nxt: Column) -> Column:
        def reachable(c: Column) -> Column:
            moved = F.transform(
                F.sequence(F.lit(0), c),
                lambda d: F.concat(
                    F.transform(F.get(acc, c - d), lambda p: p + d),
                    F.transform(F.get(acc, c - d), lambda p: p - d),
                ),
            )
            return F.array_intersect(nxt, F.flatten(moved))

        return F.transform(levels, reachable)

    rest = F.slice(slots, 2, F.size(slots))
    reached = F.aggregate(rest, start, step)
    return F.size(F.array_distinct(F.flatten(reached)))


def phrase_matches(phrases: DataFrame, postings: DataFrame, keys, small: bool) -> DataFrame:
    """(qid, keys, clause columns, field, dl, tf) where the phrase occurs.

    Carries ``idf`` (sum over the phrase's terms) and ``avgdl`` when ``phrases``
    has been joined with term weights.
    """
    weighted = "df" in phrases.columns
    joined = join_queries(postings.where(F.col("term") != DOC_MARKER), phrases, keys, small)
    aggregates = [
        F.collect_list(
            F.struct(
                F.col("offset"),
                F.transform("positions", lambda p: p - F.col("offset")).alias("at"),
            )
        ).alias("parts"),
        F.max("dl").alias("dl"),
    ]
    if weighted:
        aggregates += [
            F.sum(idf("n_docs", "df")).alias("idf"),
            F.max("avgdl").alias("avgdl"),
        ]
    grouped = (
        joined.groupBy(
            "qid", *keys, "required", "clause_id", "occur", "field",
            "n_terms", "slop", "boost",
        )
        .agg(*aggregates)
        .where(F.size("parts") == F.col("n_terms"))
        .withColumn("slots", F.transform(F.array_sort("parts"), lambda p: p["at"]))
    )
    counted = grouped.withColumn("tf", phrase_frequency(F.col("slots"), F.col("slop")))
    return counted.where(F.col("tf") > 0).drop("parts", "slots", "n_terms", "slop")


def _phrase_scores(compiled, postings, weights, keys, small) -> DataFrame:
    matches = phrase_matches(
        compiled.phrases.join(weights, list(TERM_KEY)), postings, keys, small
    )
    score = F.col("boost") * F.col("idf") * tf_weight("tf", "dl", "avgdl")
    return matches.withColumn("score", score).select(*_contribution(keys))


def _range_scores(compiled, corpus) -> DataFrame:
    """Constant score per (query, document, clause, field) with a term in the range."""

    def join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        # Larger tables are shuffled once: copies of them for each salt would outweigh the
        # postings, and adaptive execution splits the terms that are frequent.
        return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on)

    columns = ["required", "clause_id", "occur", "boost"]
    found = range_matches(compiled.ranges, corpus, join, columns)
    return found.withColumn("score", F.col("boost")).select(*_contribution(corpus.keys))


def score_documents(corpus, compiled: CompiledRequests) -> DataFrame:
    """All matches: (qid, keys, score), score rounded and unranked.

    A request asks one index and a key belongs to one, so the index name is left
    out of the grouping; :func:`keyword_pool` puts it back on the winners.
    """
    profile, keys = compiled.profile, corpus.keys
    small = fits_broadcast(compiled)
    postings = corpus.postings_for(compiled, small)
    weights = with_field_totals(corpus.statistics_for(compiled, postings), small)
    # Parts of one kind alone stay where their documents are; a union would shuffle them again.
    parts = [_term_scores(compiled, postings, weights, keys, small)] if profile.any_term else []
    if profile.any_phrase:
        parts.append(_phrase_scores(compiled, postings, weights, keys, small))
    if profile.any_range:
        parts.append(_range_scores(compiled, corpus))
    if not parts:
        parts = [_term_scores(compiled, postings, weights, keys, small)]
    contributions = reduce(DataFrame.unionByName, parts)

    doc = ["qid", *keys]
    if profile.plain:
        total = contributions.groupBy(*doc).agg(F.sum("score").alias("score"))
    else:
        total = _combine(contributions, doc, profile)
    return total.withColumn("score", F.round("score", SCORE_DIGITS))


def _combine(contributions: DataFrame, doc: list[str], profile) -> DataFrame:
    """Must, should and must-not in one aggregation."""
    is_must = F.col("occur") == "must"
    if profile.max_clauses <= MASK_CLAUSES:
        got = F.bit_or(
            F.when(is_must, clause_bit(F.col("clause_id"))).otherwise(F.lit(0).cast("long"))
        )
    else:
        got = F.size(F.collect_set(F.when(is_must, F.col("clause_id")))).cast("long")
    excluded = F.col("occur") == "must_not"
    return (
        contributions.groupBy(*doc)
        .agg(
            F.sum(F.when(excluded, F.lit(0.0)).otherwise(F.col("score"))).alias("score"),
            got.alias("got"),
            F.max("required").alias("required"),
            F.max(excluded).alias("excluded"),
            F.max(~excluded).alias("included"),
        )
        .where((F.col("got") == F.col("required")) & ~F.col("excluded") & F.col("included"))
        .select(*doc, "score")
    )


def best_scores(corpus, compiled: CompiledRequests, limits: DataFrame, overfetch: int, prune: bool) -> DataFrame:
    """Scores (qid, keys, score) that hold the best of each request; ``limits`` has (qid, pool).

    Batches of plain words are scored in blocks, very large ones in several
    passes; with ``prune``, documents that cannot reach the pool are left out of
    the scoring.  Other requests, and
    boosts that are not positive, get the scores of all their matches.
    """
    profile, keys = compiled.profile, corpus.keys
    small = fits_broadcast(compiled)
    blocks = profile.term_rows >= BLOCK_TERMS
    simple = profile.plain and (prune or blocks)
    if not simple or not compiled.terms.where(~(F.col("boost") > 0)).isEmpty():
        return score_documents(corpus, compiled)
    if not small and not prune:
        found = _scored_in_passes(corpus, compiled, profile.max_limit * overfetch)
        return found.withColumn("score", F.round("score", SCORE_DIGITS))
    # Statistics and scores both read the postings; in one plan each would make its own.
    postings = corpus.settled(corpus.postings_for(compiled, small))
    weights = with_field_totals(corpus.statistics_for(compiled, postings), small)
    valued = valued_postings(postings, weights, keys, small)
    terms = compiled.terms.where(F.col("qid").isNotNull()).select("qid", *TERM_KEY, "boost")
    most = profile.max_limit * overfetch
    if prune:
        fan = lambda postings, terms: fan_out(postings, terms, keys, small)
        found = pruned_scores(scratch_table(valued), terms, limits.select("qid", "pool"), keys, most, fan, small).scores
    else:
        join = lambda rows, table: join_queries(rows, table, keys, small)
        found = block_scores(valued, terms, keys, most, corpus.document_count(), join)
    return found.withColumn("score", F.round("score", SCORE_DIGITS))


def _scored_in_passes(corpus, compiled: CompiledRequests, pool: int) -> DataFrame:
    """Scores for requests that are too many to broadcast, as :func:`passes_scores` gives them."""
    profile, keys = compiled.profile, corpus.keys
    few = compiled.wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    postings = corpus.settled(corpus.postings_for(compiled, few))
    weights = with_field_totals(corpus.statistics_for(compiled, postings), few)
    numbered = scratch_table(weights.withColumn("term_number", F.monotonically_increasing_id()))
    rows = join_queries(postings, numbered, keys, few).select(*keys, "term_number", _worth())
    packed = scratch_table(packed_documents(rows, keys, corpus.document_count()))
    named = numbered.select(*TERM_KEY, "term_number")
    asked = compiled.terms.join(F.broadcast(named) if few else named, list(TERM_KEY))
    asked = asked.where(F.col("qid").isNotNull()).select("qid", "term_number", "boost")
    return passes_scores(packed, asked, profile.term_rows, keys, pool)


def keyword_pool(
    corpus, compiled: CompiledRequests, overfetch: int = OVERFETCH, prune: bool = False
) -> DataFrame:
    """The best ``overfetch * limit`` matches per query: (qid, index_name, keys, bm25, bm25_rank).

    ``prune`` gives the same rows by a way that pays for few words among very
    frequent ones; it takes more passes over the postings of those words.
    """
    limits = compiled.requests.select(
        "qid", "index_name", (F.col("limit") * overfetch).alias("pool")
    )
    scored = best_scores(corpus, compiled, limits, overfetch, prune).withColumnRenamed("score", "bm25")
    order = [F.desc("bm25"), *[F.asc(k) for k in corpus.keys]]
    pool = top_k(
        scored, ["qid"], order, compiled.profile.max_limit * overfetch, rank="bm25_rank"
    )
    right = F.broadcast(limits) if fits_broadcast(compiled) else limits
    return pool.join(right, "qid").where(F.col("bm25_rank") <= F.col("pool")).drop("pool")
