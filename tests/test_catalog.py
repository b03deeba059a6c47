"""Every catalog query against its SQL counterpart, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from termloom.operators import querylog
from termloom.plans.catalog import QUERIES
from termloom.plans.catalog_sql import ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    plain = [
        tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False, name=None)
    ]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, checker, name):
    got = QUERIES[name](spark, FOLDER).toArrow().to_pandas()
    want = checker.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_bracketed_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(querylog, "SMALL_GROUP", 100)
    log = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    got = querylog.latency_report(log, "value", "ts", exact=True).first()
    want = duckdb.execute(
        "SELECT quantile_cont(value, [0.5, 0.95, 0.99]) "
        "FROM '/root/testdata/sf0.01/events.parquet' WHERE value IS NOT NULL"
    ).fetchone()[0]
    assert [got.p50, got.p95, got.p99] == pytest.approx(want)
