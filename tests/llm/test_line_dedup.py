import random

import numpy as np
import pytest

from termloom.llm import line_dedup


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd: random.Random, text: str, edits: int, letters: str) -> str:
    out = list(text)
    for _ in range(edits):
        place = rnd.randint(0, len(out))
        kind = rnd.random()
        if kind < 0.34:
            out.insert(place, rnd.choice(letters))
        elif place < len(out):
            if kind < 0.67:
                out.pop(place)
            else:
                out[place] = rnd.choice(letters)
    return "".join(out)


def test_distance_and_filter():
    rnd = random.Random(1)
    for _ in range(6000):
        a = "".join(rnd.choice("ab\0") for _ in range(rnd.randint(0, 12)))
        b = edited(rnd, a, rnd.randint(0, 4), "abc\0")
        true = distance(a, b)
        for edits in range(4):
            assert line_dedup.within(a, b, edits) == (true <= edits)
        for edits in range(max(1, true), 4):
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            cuts = line_dedup.segment_cuts(np.array([len(short)]), edits)
            index = {(len(short), i, short[p[0] : p[0] + n[0]]) for i, (p, n) in enumerate(cuts)}
            probes = line_dedup.probe_places(np.array([len(long)]), edits)
            assert any((len(long) - shift, i, long[p[0] : p[0] + n[0]]) in index for shift, i, p, n, valid in probes if valid[0])


def brute(rows: list[tuple]) -> list[tuple]:
    docs = [(-(2**63) if d is None else d, t or "") for d, t in rows]
    lines = sorted({(k, t, i, line) for k, t in docs for i, line in enumerate(t.split("\n")) if line and not line.isspace()})
    texts = sorted({x[3] for x in lines})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= line_dedup.LEAST_CHARACTERS and abs(len(a) - len(b)) <= line_dedup.EDITS and distance(a, b) <= line_dedup.EDITS:
                root[find(a)] = find(b)
    first = {}
    for k, t, i, line in lines:
        first.setdefault(find(line), (k, i))
    out = []
    for (d, _), (k, t) in zip(rows, docs):
        cut = t.split("\n") if t else []
        gone = [i for i, line in enumerate(cut) if line in root and first[find(line)] != (k, i)]
        out.append((str(d), len(cut), tuple(gone), "\n".join(line for i, line in enumerate(cut) if i not in gone)))
    return sorted(out)


def found(docs, **options) -> list[tuple]:
    rows = line_dedup.dedup_lines(docs, **options).collect()
    return sorted((str(r.doc_id), r.n_lines, tuple(x.line for x in r.removed), r.kept) for r in rows)


def sample() -> list[tuple]:
    rnd = random.Random(4)
    letters = "abcdefgh é"
    line = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    bases = [line(rnd.randint(28, 60)) for _ in range(12)]
    head, tail = line(20), line(20)
    rows = []
    for doc in range(40):
        own = [edited(rnd, rnd.choice(bases), rnd.randint(0, 4), letters) for _ in range(rnd.randint(0, 4))]
        own += [line(rnd.randint(0, 50)) for _ in range(rnd.randint(0, 3))]
        own += [f"{head}{rnd.randint(1000, 9999)}{tail}"]
        rows.append((doc, "\n".join(own)))
    return rows


def test_common_openings(spark, monkeypatch):
    """Lines that share most of their letters are cut again and lose no link."""
    monkeypatch.setattr(line_dedup, "PAIRS", 5)
    monkeypatch.setattr(line_dedup, "BLOCK", 20)
    rnd = random.Random(8)
    letters = "abcdefgh é"
    opening, tail = "the common opening of all these ", " and an end"
    bases = [opening + "".join(rnd.choice(letters) for _ in range(rnd.randint(4, 12))) + rnd.choice(("", tail)) for _ in range(60)]
    rows = [(i, "\n".join(edited(rnd, rnd.choice(bases), rnd.randint(0, 3), letters) for _ in range(6))) for i in range(30)]
    rows += [(100, opening), (101, "short\nlines\nthat repeat"), (102, "that repeat\nshorter\nshort"), (103, "é\n\n \né")]
    want = brute(rows)
    assert sum(len(r[2]) for r in want) > 50
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


@pytest.mark.parametrize(("block", "flush", "few"), [(line_dedup.BLOCK, line_dedup.FLUSH, line_dedup.BROADCAST_LINES), (3, 200, 0)])
def test_lines_against_all_pairs(spark, monkeypatch, block, flush, few):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", few)
    monkeypatch.setattr(line_dedup, "FLUSH", flush)
    rows = sample()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd_rows(spark):
    a, b = "first line of thirty or more letters", "another line that is just as long as that"
    rows = [(None, a), (1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, f"{b}\n\n{b}x\nshort"), (3, None), (3, ""), (4, " " * 50), (None, None)]
    docs = spark.createDataFrame([(*r, "n", 5) for r in rows], "doc_id long, text string, line string, carried int")
    assert found(docs) == brute(rows)
    carried = line_dedup.dedup_lines(docs, carried=["line", "doc_id"]).first().carried
    assert carried.line == "n"


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
