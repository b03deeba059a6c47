import random
import re

import numpy as np
import pytest

from termloom.llm import jaccard_join
from termloom.llm.shingles import shingle_sets


def shingles(text: str | None) -> set:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i), d))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def sample() -> list[tuple]:
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = [" ".join(text(rnd.randint(0, 90))) for _ in range(60)]
    for size, copies in ((100, 40), (60, 25), (300, 6)):
        base = text(size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, max(2, size // 40))):
                own[rnd.randrange(size)] = rnd.choice(words)
            rows.append(" ".join(own))
    chain = text(80)
    for i in range(12):  # each is near the next only
        chain[5 * i : 5 * i + 2] = text(2)
        rows.append(" \n".join(chain).upper())
    passage = text(30)
    rows += [" ".join(text(rnd.randint(5, 40)) + passage) for _ in range(30)]
    rows += ["a b c", "A  b\tc", "a b c d", "", " \n", rows[3], rows[70], "x " * 500]
    return [(i, r) for i, r in enumerate(rows)]


def found(docs, **options) -> list[tuple]:
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(docs, **options).collect())


@pytest.mark.parametrize(("block", "frequent", "few"), [(jaccard_join.BLOCK, jaccard_join.FREQUENT, 500_000), (300, 4, 0)])
def test_components_against_all_pairs(spark, monkeypatch, block, frequent, few):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BROADCAST_CLASSES", few)
    rows = sample()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block) == brute(rows)


def test_odd_rows(spark):
    long = "one two three four five six seven"
    rows = [(None, long), (4, long), (4, long), (2, "q r s t u v"), (2, long), (9, None), (9, None), (None, "nobody else has these words"), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    assert found(docs) == brute(rows)
    stays = [r for r in jaccard_join.jaccard_components(docs).collect() if r.stays]
    assert sorted((str(r.doc_id), r.n_shingles) for r in stays) == [("2", 2), ("2", 3), ("9", 0), ("9", 0), ("None", 0), ("None", 1)]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_search_finds_all_within_the_threshold():
    rnd = np.random.default_rng(1)
    base = rnd.integers(1, 2**62, 60, np.int64).view(np.uint64)
    sets = []
    for _ in range(120):
        keep = base[rnd.random(60) < rnd.choice([0.5, 0.85, 1.0])]
        sets.append(np.unique(np.r_[keep, rnd.integers(1, 2**62, rnd.integers(0, 12), np.int64).view(np.uint64)]))
    lists = jaccard_join.InvertedLists(sets)
    for s in sets:
        near, overlap = lists.search(s)
        want = {j: len(np.intersect1d(s, t)) for j, t in enumerate(sets)}
        want = {j: n for j, n in want.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)}
        assert dict(zip(near.tolist(), overlap.tolist())) == want


def test_spanning_edges():
    rnd = random.Random(7)
    for _ in range(200):
        edges = [(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(rnd.randint(0, 40))]
        root = {n: n for e in edges for n in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = {(find(n), n) for n in root if find(n) != n}
        got = jaccard_join.spanning(np.array(edges, np.int64).reshape(-1, 2))
        assert {tuple(e) for e in got.tolist()} == want and len(got) == len(want)


def test_shingles():
    texts = ["", "a", "A b c d", "a b c d e f a b c d e f", "\xa0 q", "x" * 5000 + " y"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]
