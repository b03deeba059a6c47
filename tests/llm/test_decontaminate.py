import random

import numpy as np
import pytest

from termloom.llm import decontaminate


def brute(item: list, text: list, least: int) -> list[tuple[int, int, int]]:
    marked, out = ([0] * len(item), [0] * len(text)), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not marked[0][i + k] and not marked[1][j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not any(marked[0][i : i + best]) and not any(marked[1][j : j + best]):
                marked[0][i : i + best] = marked[1][j : j + best] = [1] * best
                out.append((i, j, best))


def test_tiles_against_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        item = [rnd.randint(1, 5) for _ in range(rnd.randint(1, 14))]
        text = [rnd.randint(1, 7) for _ in range(rnd.randint(0, 30))]
        least = rnd.randint(1, 4)
        got = decontaminate.tile(np.array(item, np.uint64), np.array(text, np.uint64), least)
        assert got == brute(item, text, least)


ITEM = [f"term{i}" for i in range(20)]
ROWS = [
    (1, "before " + " ".join(ITEM) + " after"),
    (2, " ".join(ITEM[10:]).upper() + ", then, " + " ".join(ITEM[:10])),  # in two pieces, the other way round
    (3, " ".join(ITEM[:8])),
    (4, " ".join(x for pair in zip(ITEM, ["no"] * 20) for x in pair)),
    (5, None),
    (6, ""),
    (None, "tiny item"),
    (7, "nothing of the kind " * 2000),
    (7, "nothing of the kind " * 2000),
]


@pytest.mark.parametrize("words", [decontaminate.PASS_WORDS, 5])
def test_rows(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", words)
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(8, " ".join(ITEM)), (9, "Tiny item!"), (10, None), (11, ""), (12, " ".join(ITEM))], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert {d: list(r["items"]) for d, r in by_id.items()} == {1: [8, 12], 2: [8, 12], 3: [], 4: [], 5: [], 6: [], 7: [], None: [9]}
    assert by_id[3].max_coverage == 0.4
    assert [r.contaminated for r in got] == [r.n_items > 0 for r in got]


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM)), (2, "Tiny item"), (3, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(ITEM)), (9, "Tiny item!"), (None, "tiny item")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, list(r["items"]), r.max_coverage) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (True, 0, [], 1.0), 2: (True, 1, [9], 1.0), 3: (False, 0, [], 0.0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert not decontaminate.contamination(docs, none).first().contaminated
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


def test_long_texts_of_few_words():
    one = np.ones(50_000, np.uint64)
    assert decontaminate.tile(one[:400], one) == [(0, 0, 400)]
    two = np.tile(np.array([1, 2, 1], np.uint64), 20_000)
    got = decontaminate.tile(np.array([1, 2, 1, 1, 2, 1, 2, 1] * 50, np.uint64), two)
    assert got[0][2] == max(t[2] for t in got)
    for i, j, size in got:
        assert size >= decontaminate.LEAST_MATCH
    taken = np.concatenate([np.arange(i, i + size) for i, _, size in got])
    assert len(np.unique(taken)) == len(taken)


@pytest.mark.parametrize("size", [30, 60])
def test_periodic_tiles_against_brute_force(size):
    rnd = random.Random(size)
    for _ in range(20):
        unit = [rnd.randint(1, 2) for _ in range(rnd.randint(1, 4))]
        item = [w if rnd.random() < 0.9 else 3 for w in unit * size][: size // 2]
        text = [w if rnd.random() < 0.9 else 4 for w in unit * size][:size]
        got = decontaminate.tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert got == brute(item, text, 3)


def test_copies_of_one_item(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 50)
    docs = spark.createDataFrame([(1, " ".join(ITEM)), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(ITEM)) for i in range(300)] + [(0, " ".join(ITEM)), (900, "tiny item " * 400)], "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: list(range(300)), 2: []}
