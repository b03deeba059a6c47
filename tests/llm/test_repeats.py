import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from termloom.llm import catalog, repeats

L = repeats.LENGTH


def brute(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i : i + L] for t in texts for i in range(len(t) - L + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - L + 1):
            if seen[t[i : i + L]] > 1:
                covered[i : i + L] = True
        runs = int((covered & ~np.r_[False, covered[:-1]]).sum()) if len(t) else 0
        rest = np.frombuffer(t, np.uint8)[~covered].tobytes() if len(t) else b""
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def test_index_against_counting():
    rnd = random.Random(3)
    for _ in range(150):
        length = rnd.choice([1, 2, 3, 5, 8, 20])
        base = bytes(rnd.choice(b"abc\x00\xff") for _ in range(60))
        segments = list({base[i : i + rnd.randint(length, 40)] if rnd.random() < 0.6 else bytes(rnd.choice(b"ab") for _ in range(rnd.randint(length, 30))) for i in [rnd.randint(0, 20) for _ in range(rnd.randint(1, 12))]})
        weights = np.array([rnd.choice([1, 1, 1, 2]) for _ in segments])
        counts = Counter()
        for s, w in zip(segments, weights):
            for i in range(len(s) - length + 1):
                counts[s[i : i + length]] += w
        want = [[i for i in range(len(s) - length + 1) if counts[s[i : i + length]] > 1] for s in segments]
        assert [x.tolist() for x in repeats.repeated_starts(segments, weights, length)] == want


def random_texts() -> list[str]:
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(70), text(45)
    out = [text(rnd.randint(0, 120)) for _ in range(30)]
    out += [text(rnd.randint(0, 40)) + passage + text(rnd.randint(0, 40)) for _ in range(60)]
    out += [passage[:199], passage[:200], passage[:201], other * 4, "", "a" * 1000, out[5], out[5], text(900)]
    out += [out[-1].replace(" ", "  ", 3), "é" * 150, "x" + "é" * 150]
    return out


@pytest.mark.parametrize("large", [repeats.LARGE, 2_000])
@pytest.mark.parametrize("few", [repeats.BROADCAST_SEGMENTS, 0])
def test_query_against_counting(spark, monkeypatch, large, few):
    monkeypatch.setattr(repeats, "LARGE", large)
    monkeypatch.setattr(repeats, "BROADCAST_SEGMENTS", few)
    texts = random_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    monkeypatch.setattr(catalog, "table", lambda *_: docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in catalog.op1_suffix_dedup(spark, "").collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))


def test_odd_rows(spark):
    long = "b" + "0123456789" * 30
    rows = [(None, "q" * 10), (1, None), (2, ""), (3, long), (3, long), (3, "other"), (None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == sorted(
        (str(d), len(t or ""), len(t) if t == long else 0) for d, t in rows
    )


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert repeats.remove_repeats(spark.createDataFrame([(1, "short")], "doc_id long, text string")).first().n_removed == 0
