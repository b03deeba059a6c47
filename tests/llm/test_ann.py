import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import ann


def clustered(n: int, dims: int = 24, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dims))
    return centres[rng.integers(0, 8, n)] + 0.6 * rng.standard_normal((n, dims))


def frame(spark, ids, vectors):
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "q") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string")


def found(rows, k=20):
    out: dict[int, list] = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize(("block", "queries"), [(ann.BLOCK, ann.QUERIES), (400, 30)])
def test_recall_and_scores(spark, monkeypatch, block, queries):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERIES", queries)
    vectors = clustered(1500)
    got = found(frame(spark, range(1500), vectors).repartition(3))
    hits = 0
    for q in range(0, 1500, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(s == pytest.approx(vectors[v] @ vectors[q], abs=1e-12) for _, v, s in got[q])
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
    assert hits / (75 * 20) >= 0.9


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (5, [0.0, 2.0]), (5, [0.0, 2.0])]
    bad = [(20, None), (40, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0]), (11, [])]
    got = found(frame(spark, *zip(*good, *bad)))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 5, 0.0)]}


def exact(vectors, k=20):
    out = {}
    for q in range(0, len(vectors), 20):
        scores = np.where(np.arange(len(vectors)) == q, -np.inf, vectors @ vectors[q])
        out[q] = np.argsort(-scores, kind="stable")[: min(k, len(vectors) - 1)].tolist()
    return out


def copied(n: int = 800, dims: int = 24) -> np.ndarray:
    """Unit vectors, three in five of which lie in three groups of near-copies."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((n, dims))
    group = np.flatnonzero(rng.random(n) < 0.6)
    vectors[group] = rng.standard_normal((3, dims))[group % 3] + 1e-9 * rng.standard_normal((len(group), dims))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def test_copies_do_not_hide_the_neighbours_of_others(spark):
    vectors = copied()
    want = exact(vectors)
    got = found(frame(spark, range(len(vectors)), vectors))
    assert {len(r) for r in got.values()} == {20}
    others = [q for q in want if vectors[want[q][-1]] @ vectors[q] < 0.99]
    assert len(others) > 5
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in others]) >= 0.9


def test_small_tables_are_searched_whole(spark):
    for n in (2, 12, 21):
        vectors = np.random.default_rng(n).standard_normal((n, 32))
        assert {q: [v for _, v, _ in r] for q, r in found(frame(spark, range(n), vectors)).items()} == exact(vectors)


def test_all_are_candidates_where_probes_do_not_reach_the_recall(monkeypatch):
    monkeypatch.setattr(ann, "MOST_PROBES", 2)
    monkeypatch.setattr(ann, "WIDTH", 0.05)
    vectors = clustered(500)
    hashing = ann.fit(vectors, float(np.linalg.norm(vectors, axis=1).max()), 20)
    assert hashing.exact and ann.Tables(hashing, vectors).candidates(vectors[:7]).all()


def test_tables_without_vectors(spark):
    rows = frame(spark, [0, 20], [[1.0], None])
    assert found(rows) == {} and found(rows.limit(0)) == {}
    assert found(frame(spark, [20, 1], [None, [0.0]])) == {}


def test_probes_go_by_expected_cost():
    order = ann.probe_order(4, 50)
    assert not order[0].any() and len({tuple(r) for r in order.tolist()}) == 50
    assert not (order[:, :4] & order[:, :3:-1]).any()  # never both boundaries of one function
