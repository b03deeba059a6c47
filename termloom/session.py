"""Session settings the package is tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Text that one task splits into tokens, and text in one bucket of a store.  Tokens that are
# sorted or grouped take some 25 times as much memory as their text.
TASK_TEXT = 8 * 1024 * 1024
BUCKET_TEXT = 16 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("termloom")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a folder on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="termloom-")


def scratch_table(rows: DataFrame) -> DataFrame:
    """``rows``, written to the work folder and read back: computed once, and safe from lost executors."""
    path = f"{work_folder(rows.sparkSession)}/scratch-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def text_bytes(rows: DataFrame, columns: Sequence[str]) -> int:
    """Bytes of text in ``columns``, measured by one pass over ``rows``."""
    size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns))
    return rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def text_partitions(rows: DataFrame, columns: Sequence[str]) -> int | None:
    """Partitions for a shuffle of the tokens of ``rows``: None, the session's own number, if that is enough.

    The session's number does not grow with the input; what a task holds then would.
    """
    wanted = -(-text_bytes(rows, columns) // TASK_TEXT)
    return wanted if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def bucket_count(rows: DataFrame, columns: Sequence[str] = ("title", "body"), least: int = 8) -> int:
    """Buckets for a store that is to hold ``rows``, so that one suits one task."""
    return max(least, -(-text_bytes(rows, columns) // BUCKET_TEXT))


def repartitioned(rows: DataFrame, partitions: int | None, *columns: str) -> DataFrame:
    """``rows`` by ``columns``, in the session's number of partitions if ``partitions`` is None."""
    return rows.repartition(partitions, *columns) if partitions else rows.repartition(*columns)
