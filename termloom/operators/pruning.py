"""Best-k keyword scores without scoring the documents that cannot be among them.

Each term of a request adds at most a known amount to a score.  The rarest
terms are scored first; the k-th best of these partial scores is a floor that
the final k-th score cannot be below.  The terms that matter least are set
aside as long as all of them together stay below the floor: a document that
has no other term is never scored.  Documents that remain are checked once
more against what they can still gain, and only for those are the postings of
the terms set aside looked up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.clauses import TERM_KEY
from termloom.operators.topk import top_k
from termloom.session import scratch_table

# Rounded scores differ from sums by less than this, so ties at the k-th place stay.
SLACK = 1e-5
# The first pass takes a request's rarest terms until they have this many postings for each hit wanted.
SEED_POSTINGS = 8


def _last(by: Sequence[Column]) -> Window:
    return Window.partitionBy("qid").orderBy(*by)


def term_bounds(terms: DataFrame, valued: DataFrame) -> DataFrame:
    """``terms`` (qid, index_name, field, term, boost) that have postings, with the most each adds, and df."""
    most = valued.groupBy(*TERM_KEY).agg(F.max("worth").alias("worth"), F.count("*").alias("df"))
    joined = terms.join(most, list(TERM_KEY))
    return joined.select("qid", *TERM_KEY, "boost", (F.col("boost") * F.col("worth")).alias("most"), "df")


def seed_terms(asked: DataFrame, pools: DataFrame) -> DataFrame:
    """The terms of each request that add most, up to a number of postings that suffices for its pool."""
    order = _last([F.desc("most"), *TERM_KEY])
    before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = asked.withColumn("before", before).join(pools, "qid")
    return counted.where(F.col("before") < SEED_POSTINGS * F.col("pool")).select(*asked.columns)


def floors(partial: DataFrame, pools: DataFrame, max_pool: int) -> DataFrame:
    """(qid, floor): the pool's last partial score, for requests whose pool is full."""
    best = top_k(partial, ["qid"], [F.desc("score")], max_pool)
    full = best.join(pools, "qid").where(F.col("rank") == F.col("pool"))
    return full.select("qid", (F.col("score") - SLACK).alias("floor"))


def split_terms(asked: DataFrame, floor: DataFrame) -> DataFrame:
    """``asked`` with ``floor``, ``needed`` (false: set aside) and ``rest``, what those set aside add at most."""
    order = _last([F.asc("most"), *TERM_KEY])
    up_to = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = asked.join(floor, "qid", "left").withColumn(
        "needed", F.col("floor").isNull() | (up_to >= F.col("floor"))
    )
    aside = F.sum(F.when(F.col("needed"), F.lit(0.0)).otherwise(F.col("most"))).over(Window.partitionBy("qid"))
    return marked.withColumn("rest", aside)


@dataclass(frozen=True)
class Pruned:
    """The steps of one evaluation; ``scores`` is its result (qid, keys, score)."""

    asked: DataFrame
    candidates: DataFrame
    lookups: DataFrame
    scores: DataFrame


def pruned_scores(
    valued: DataFrame, terms: DataFrame, pools: DataFrame, keys: Sequence[str], max_pool: int, fan_out, few: bool
) -> Pruned:
    """Scores of all documents that can be among the best ``pool`` of a request, and of some more.

    ``valued`` (index_name, field, term, keys, worth) is read several times and
    should be a written table; boosts must not be negative.  ``fan_out(postings,
    terms)`` joins postings with the requests that ask for their term; ``few``
    says that one row for each request may be broadcast.
    """
    doc = ["qid", *keys]

    def scored(some: DataFrame) -> DataFrame:
        found = fan_out(valued, some.select("qid", *TERM_KEY, "boost"))
        return found.select(*doc, (F.col("boost") * F.col("worth")).alias("score"))

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*doc).agg(F.sum("score").alias("score"))

    asked = scratch_table(term_bounds(terms, valued))
    floor = floors(total(scored(seed_terms(asked, pools))), pools, max_pool)
    parted = scratch_table(split_terms(asked, floor))
    limits = parted.select("qid", "floor", "rest").distinct()
    limits = F.broadcast(limits) if few else limits
    reached = F.col("floor").isNull() | (F.col("score") + F.col("rest") >= F.col("floor"))
    main = total(scored(parted.where("needed"))).join(limits, "qid").where(reached)
    candidates = scratch_table(main.select(*doc, "score"))
    aside = parted.where(~F.col("needed")).select("qid", *TERM_KEY, "boost")
    wanted = candidates.select(*doc).join(F.broadcast(aside) if few else aside, "qid")
    lookups = wanted.join(valued, [*TERM_KEY, *keys]).select(*doc, (F.col("boost") * F.col("worth")).alias("score"))
    return Pruned(parted, candidates, lookups, total(candidates.union(lookups)))
