import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import catalog, periodic_runs


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing the text with itself at every distance."""
    least = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end > at and end + p - at >= max(12, 2 * p):
                least.setdefault((at, end + p), p)
            at = max(end, at) + 1
    return sorted((s, e - s, p) for (s, e), p in least.items())


def found(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts that share a pass, through the arrays."""
    order = sorted(range(len(texts)), key=lambda d: -len(texts[d]))
    number, ids, ends = {}, [], []
    for d in order:
        ids += [number.setdefault(w, len(number)) for w in texts[d]]
        ends.append(len(ids))
        ids.append(-1 - d)
    runs = periodic_runs.runs_of(np.array(ids, np.int64), np.array(ends))
    out = [[] for _ in texts]
    for s, e, p in zip(runs.start.tolist(), runs.end.tolist(), runs.period.tolist()):
        place = next(i for i, end in enumerate(ends) if s < end)
        begin = ends[place - 1] + 1 if place else 0
        out[order[place]].append((s - begin, e - s, p))
    return [sorted(r) for r in out]


def fibonacci(n: int) -> str:
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def seams(rnd: random.Random, n: int) -> str:
    """Highly periodic stretches that meet out of phase."""
    out = ""
    while len(out) < n:
        root = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9)))
        for _ in range(rnd.randint(1, 4)):
            out += (root * 40)[: rnd.randint(1, 120)]
    return out[:n]


def doubled(rnd: random.Random, n: int) -> str:
    """Repetitions of repetitions."""
    out = "".join(rnd.choice("abcd") for _ in range(5))
    while len(out) < n:
        cut = rnd.randint(0, len(out) - 1)
        out = out + out[cut:] * rnd.randint(1, 2) + rnd.choice("abcdefgh")
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    texts = [fibonacci(700), thue_morse(600), "a" * 500, "ab" * 250 + "a" + "ab" * 250, "", "a", "ab" * 6]
    texts += [seams(rnd, rnd.randint(10, 900)) for _ in range(12)]
    texts += [doubled(rnd, rnd.randint(10, 900)) for _ in range(12)]
    texts += ["".join(rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 300))) for _ in range(20)]
    for text, got in zip(texts, found([list(t) for t in texts])):
        assert got == brute(list(text))


def test_long_texts_pass_the_kept_levels(monkeypatch):
    monkeypatch.setattr(periodic_runs, "LEVELS", 4)
    rnd = random.Random(9)
    texts = [seams(rnd, 1500), doubled(rnd, 1500), "".join(rnd.choice("abcdef") for _ in range(300)) * 5]
    assert [brute(list(t)) for t in texts] == found([list(t) for t in texts])


def test_collisions_are_noticed():
    ids = np.array([0, 1] * 10)
    with pytest.raises(periodic_runs.HashCollision):
        periodic_runs._check(ids, periodic_runs.Runs(np.array([0]), np.array([20]), np.array([3])))


def test_synchronising_sets_are_consistent_and_dense():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 3, 4000)
    ids[1000:1300], ids[2000:2200] = ids[3000:3300], 0
    names = periodic_runs._mix(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):
        names = periodic_runs._double(names, step)
    flat = periodic_runs._covered(periodic_runs._compared(ids), 8, len(names))
    chosen = set(periodic_runs.synchronising(names, None, 8).tolist())
    assert {c - 1000 for c in chosen if 1000 <= c < 1284} == {c - 3000 for c in chosen if 3000 <= c < 3284}
    assert all(any(i + j in chosen for j in range(8)) for i in range(1900))
    assert flat[2050] and len(chosen) < 2000


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\f\r "),
    (4, "la " * 40),
    (5, "x y z " * 5 + "x"),
    (5, "x y z " * 5 + "x"),
    (None, "one two three " * 7),
    (6, "no run here at all"),
    (7, "  é ü\x1c " * 9),
    (8, " ".join(f"w{i % 700}" for i in range(2000))),
] + [(i, f"head {i} " + " ".join(random.Random(i).choice("abc") for _ in range(i % 97))) for i in range(10, 200)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    drop = {i for s, l, p in runs for i in range(s + p, s + l)}
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "a", 3) for r in ROWS], "doc_id long, text string, runs string, n_words long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [expected(*r) for r in ROWS]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in ROWS) > 10
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_operator_keeps_texts(spark):
    docs = spark.createDataFrame([(1, "a  b " * 8), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert rows[1].collapsed == "a b" and [tuple(r) for r in rows[1].runs] == [(0, 16, 2)] and rows[1].n_words == 16
    assert rows[2].collapsed == "" and rows[2].runs == []
    assert periodic_runs.find_runs(docs.where(F.lit(False))).collect() == []
