"""The streamed latency report against the batch one, with late rows and a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from termloom.operators.querylog import ACCURACY
from termloom.streaming.latency import latency_windows, report_stream

SCHEMA = "at timestamp, kind string, us long"
START = datetime(2024, 5, 1)


def rows(rng, hours, n):
    return [(START + timedelta(hours=rng.uniform(*hours)), rng.choice("ab"), rng.randint(1, 10**6)) for _ in range(n)]


def run(spark, folder, parts, first=0):
    """Each part is one micro-batch; the stream is started anew for each."""
    for number, part in enumerate(parts, first):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/log")
        windows = latency_windows(stream, "us", "at", ["kind"], late="90 minutes")
        report_stream(windows, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    found = spark.read.schema(windows.schema).parquet(f"{folder}/out").collect()
    return {(r.start, r.kind): (r.n, r.p50, r.p95, r.p99) for r in found}


def expected(kept, closed):
    out = {}
    for at, kind, us in kept:
        if us is not None and at is not None:
            out.setdefault((at.replace(minute=0, second=0, microsecond=0), kind), []).append(us)
    cut = lambda v, p: float(v[-(-int(p * 100) * len(v) // 100) - 1])
    return {k: (len(v), *(cut(sorted(v), p) for p in (0.5, 0.95, 0.99))) for k, v in out.items() if k[0] + timedelta(hours=1) <= closed}


def test_windows_are_emitted_once_and_late_rows_left_out(spark, tmp_path):
    rng = random.Random(1)
    first = rows(rng, (0, 6), 400) + [(None, "a", 5), (START, "b", None)]
    slightly_late, too_late = rows(rng, (5.0, 5.9), 60), rows(rng, (0, 2), 50)
    last = rows(rng, (6, 12), 400) + slightly_late + too_late
    got = run(spark, str(tmp_path), [first, last, []])
    closed = max(r[0] for r in last) - timedelta(minutes=90)
    kept = [r for r in first + last if r not in too_late]
    assert got == expected(kept, closed) and len(got) > 15
    # A restart without new rows emits nothing again.
    assert run(spark, str(tmp_path), [[]], 3) == got


def test_rank_error_of_large_windows(spark, tmp_path):
    n = 6 * ACCURACY
    log = spark.range(n).select(
        F.lit(START).cast("timestamp").alias("at"), F.lit("a").alias("kind"), ((F.col("id") * 7919) % n).alias("us")
    )
    log.union(spark.createDataFrame([(START + timedelta(hours=9), "a", 1)], SCHEMA)).write.parquet(f"{tmp_path}/log")
    (_, p50, p95, p99), = (v for k, v in run(spark, str(tmp_path), [[]]).items() if k[0] == START)
    for found, level in ((p50, 0.5), (p95, 0.95), (p99, 0.99)):
        assert abs(found - level * n) <= n / ACCURACY + 1
