"""Throughput and latency percentiles of a request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (0.5, 0.95, 0.99)
NAMES = ("p50", "p95", "p99")

# Rank error of the approximate percentiles is at most 1 / ACCURACY.
ACCURACY = 10_000
SMALL_GROUP = 10 * ACCURACY


def latency_report(
    log: DataFrame, timing: str, at: str, by: Sequence[str] = (), exact: bool = False
) -> DataFrame:
    """Per group: n, qps, p50, p95, p99 of ``timing``; ``at`` is the request time.

    The default percentiles are approximate and merge in constant space.  The
    exact ones are interpolated between neighbouring timings.
    """
    rows = log.where(F.col(timing).isNotNull()).select(
        *by, F.col(timing).cast("double").alias("v"), F.col(at).cast("timestamp").alias("t")
    )
    elapsed = F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))
    margin = 2.0 / ACCURACY
    low = [p - margin for p in LEVELS]
    high = [min(1.0, p + margin) for p in LEVELS]
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        elapsed.alias("elapsed_us"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", [*LEVELS, *low, *high], ACCURACY).alias("cuts"),
    )
    qps = F.when(F.col("elapsed_us") > 0, F.col("n") / (F.col("elapsed_us") / 1e6)).alias("qps")
    if not exact:
        near = [F.get("cuts", i).alias(name) for i, name in enumerate(NAMES)]
        return totals.select(*by, "n", qps, *near)
    return _exact(rows, totals, list(by), qps)


def _exact(rows: DataFrame, totals: DataFrame, by: list[str], qps) -> DataFrame:
    """Exact percentiles without bringing a group together.

    The approximate pass brackets each wanted rank.  Only the few timings inside
    a bracket are ordered; those below it are counted.  Groups small enough to
    be ordered whole use their full range as bracket.
    """
    k = len(LEVELS)
    small = F.col("n") <= SMALL_GROUP
    brackets = [
        F.struct(
            F.lit(i).alias("level"),
            F.when(small, F.col("least")).otherwise(F.get("cuts", k + i)).alias("low"),
            F.when(small, F.col("most")).otherwise(F.get("cuts", 2 * k + i)).alias("high"),
            ((F.col("n") - 1) * F.lit(p)).alias("place"),
        )
        for i, p in enumerate(LEVELS)
    ]
    key = by or ["one"]
    if not by:
        rows, totals = rows.withColumn("one", F.lit(1)), totals.withColumn("one", F.lit(1))
    placed = rows.join(totals.select(*key, F.array(*brackets).alias("b")), key)
    levels = placed.select(*key, "v", F.inline("b")).where(F.col("v") <= F.col("high"))
    # Timings below the bracket fold into one row per level.
    folded = levels.select(
        *key, "level", "place", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")
    )
    counted = folded.groupBy(*key, "level", "place", "v").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*key, "level").orderBy(F.asc_nulls_first("v"))
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto)

    def value_at(rank):
        """Smallest timing with more than ``rank`` timings up to and including it."""
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    found = ranked.groupBy(*key, "level", "place").agg(
        value_at(F.floor("place")).alias("lo"), value_at(F.ceil("place")).alias("hi")
    )
    part = F.col("place") - F.floor("place")
    cut = F.col("lo") + (F.col("hi") - F.col("lo")) * part
    wide = found.groupBy(*key).agg(
        *[F.max(F.when(F.col("level") == i, cut)).alias(name) for i, name in enumerate(NAMES)]
    )
    return totals.join(wide, key).select(*by, "n", qps, *NAMES)
