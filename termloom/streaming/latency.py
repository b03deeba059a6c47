"""Latency report over a request log that arrives as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.querylog import ACCURACY, LEVELS, NAMES


def latency_windows(
    log: DataFrame, timing: str, at: str, by: Sequence[str] = (), length: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Per window of event time and group: (start, end, *by, n, p50, p95, p99) of ``timing``.

    ``at`` is a timestamp; one without a time zone is read in the session's.
    The state of a window is a quantile sketch of constant size, to which rows
    are merged as they come; the rank error of a percentile is at most
    1 / ``ACCURACY`` of the window's rows, so smaller groups are exact.  Each
    percentile is a timing that occurred.  Rows that come later than ``late``
    after the newest one may find their window closed and are then left out, as
    are rows without a time or timing.
    """
    rows = log.select(*by, F.col(timing).cast("double").alias("v"), F.col(at).cast("timestamp").alias("t"))
    rows = rows.where(F.col("v").isNotNull() & F.col("t").isNotNull()).withWatermark("t", late)
    grouped = rows.groupBy(F.window("t", length).alias("w"), *by).agg(
        F.count("*").alias("n"), F.percentile_approx("v", list(LEVELS), ACCURACY).alias("cuts")
    )
    cuts = [F.get("cuts", i).alias(name) for i, name in enumerate(NAMES)]
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *cuts)


def report_stream(windows: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append each window to the Parquet table ``target`` once it is closed, exactly once."""
    writer = windows.writeStream.outputMode("append").format("parquet").option("path", target)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
