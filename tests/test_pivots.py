"""Nearest neighbours by pivots against brute force, and how many vectors a group meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import termloom.operators.knn as knn_module
import termloom.operators.pivots as pivots_module
from termloom.operators.knn import knn


def brute(vectors, queries, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(queries) @ unit(vectors).T, 6) + 0.0
    out = []
    for q, row in enumerate(scores):
        best = sorted(range(len(vectors)), key=lambda v: (-row[v], str(v)))[:k]
        out += [(q, str(v), n, row[v]) for n, v in enumerate(best, 1)]
    return out


def clustered(rng, n, dims, spread):
    centres = rng.normal(size=(12, dims))
    return centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))


def frames(spark, vectors, queries):
    v = spark.createDataFrame([(str(i), [float(x) for x in r]) for i, r in enumerate(vectors)], "id string, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(queries)], "qid long, query_embedding array<double>")
    return v.repartition(3), q


@pytest.mark.parametrize("spread,k", [(0.01, 1), (0.3, 7), (3.0, 4), (1e-4, 40)])
def test_equal_to_brute_force(spark, monkeypatch, spread, k):
    monkeypatch.setattr(knn_module, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(knn_module, "QUERIES_PER_BLOCK", 9)
    monkeypatch.setattr(knn_module, "VECTORS_PER_BLOCK", 100)
    monkeypatch.setattr(pivots_module, "MOST_PIVOTS", 10)
    rng = np.random.default_rng(k)
    vectors, queries = clustered(rng, 300, 5, spread), clustered(rng, 60, 5, spread)
    vectors[7] = vectors[8] = 0
    queries[3] = 0
    queries[10:40] = queries[10]  # a hot group
    vectors[100:150] = vectors[100]  # copies, told apart by id
    got = [(r.qid, r.id, r["rank"], r.score) for r in knn(*frames(spark, vectors, queries), k, 5).collect()]
    assert sorted(got) == [(q, i, n, pytest.approx(s, abs=1e-9)) for q, i, n, s in sorted(brute(vectors, queries, k))]


def test_far_vectors_do_not_meet_a_group(spark, monkeypatch):
    monkeypatch.setattr(pivots_module, "MOST_PIVOTS", 24)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = centres[np.arange(1200) % 12] + 0.02 * rng.normal(size=(1200, 16))
    queries = centres[np.arange(240) % 12] + 0.02 * rng.normal(size=(240, 16))
    v, q = frames(spark, vectors, queries)
    left, right = pivots_module.meetings(v, q, 5, 16, 240, 10)
    pairs = left.groupBy("group").count().join(right.groupBy("group").agg(F.count("*").alias("n")), "group")
    met = pairs.agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert met < 1200 * 240 / 4


@pytest.mark.parametrize("vectors,queries", [(0, 3), (3, 0), (2, 3)])
def test_few_rows(spark, vectors, queries):
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(vectors, 4)), rng.normal(size=(queries, 4))
    got = knn(*frames(spark, v, q), 5, 4, grouped=True).collect()
    assert sorted((r.qid, r.id) for r in got) == sorted(x[:2] for x in brute(v, q, 5))


@pytest.mark.parametrize("values,k", [(16_000_000, 4), (400, 4), (90, 30)])
def test_vectors_are_sent_in_parts_and_no_side_is_copied(spark, monkeypatch, values, k):
    """Rows for each (group, vector) or (query, block) would grow with the square of the input."""
    monkeypatch.setattr(knn_module, "QUERIES_PER_BLOCK", 9)
    monkeypatch.setattr(knn_module, "VECTORS_PER_BLOCK", 16)
    monkeypatch.setattr(knn_module, "PAIRS_AT_ONCE", 50, raising=False)
    monkeypatch.setattr(knn_module, "VALUES_PER_PASS", values, raising=False)
    rng = np.random.default_rng(k)
    vectors, queries = clustered(rng, 200, 5, 0.5), clustered(rng, 60, 5, 0.5)
    vectors[7] = queries[3] = 0
    vectors[20:120] = vectors[20]  # copies fill parts of their own
    v, q = frames(spark, vectors, queries)
    found = knn(v, q, k, 5, grouped=True)
    got = [(r.qid, r.id, r["rank"], r.score) for r in found.collect()]
    assert sorted(got) == [(a, i, n, pytest.approx(s, abs=1e-9)) for a, i, n, s in sorted(brute(vectors, queries, k))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Generate", "Join", "FlatMapCoGroups"))


def test_repeated_queries_and_vectors_without_an_id(spark):
    v = spark.createDataFrame([(None, [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0])], "qid long, query_embedding array<float>")
    got = [(r.qid, r.id, r["rank"], r.score) for r in knn(v, q, 2, 2, grouped=True).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 1, 1.0), (1, "a", 2, 1.0), (None, "c", 1, 1.0), (None, None, 2, 0.0)], key=str)
