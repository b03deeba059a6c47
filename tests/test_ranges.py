"""Range clauses against brute force, and how often the corpus is read for them."""

import random

import pytest
from pyspark.sql import functions as F

import termloom.operators.match as match_module
from samples import documents
from termloom.operators import ranges as ranges_module
from termloom.operators.clauses import clause_requests, compile_requests, match_all, term, term_range
from termloom.operators.match import score_documents
from termloom.operators.postings import ScanCorpus, scan_corpus
from termloom.sources.store import Store

LETTERS = "abcde"


def some_word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4)))


def some_rows(rng, n):
    return [(f"{some_word(rng)}{i}", some_word(rng) if i % 3 else "", " ".join(some_word(rng) for _ in range(rng.randint(0, 9)))) for i in range(n)]


def some_range(rng):
    bounds = [rng.choice([None, some_word(rng), some_word(rng)]) for _ in range(2)]
    if bounds == [None, None]:
        bounds[rng.randint(0, 1)] = some_word(rng)
    return dict(
        field=rng.choice(["title", "body", "id", None]),
        lower=bounds[0],
        upper=bounds[1],
        incl_lower=rng.random() < 0.5,
        incl_upper=rng.random() < 0.5,
    )


def inside(word, r):
    low = r["lower"] is None or word > r["lower"] or (r["incl_lower"] and word == r["lower"])
    high = r["upper"] is None or word < r["upper"] or (r["incl_upper"] and word == r["upper"])
    return low and high


def expected(rows, requests):
    """{(request, document): score}: one for each clause and field that is met."""
    out = {}
    for q, clauses in enumerate(requests):
        for d, (doc_id, title, body) in enumerate(rows):
            terms = {"title": title.split(), "body": body.split(), "id": [doc_id]}
            met = 0
            for r in clauses:
                fields = [r["field"]] if r["field"] else ["title", "body"]
                met += sum(any(inside(w, r) for w in terms[f]) for f in fields)
            if met:
                out[q, d] = float(met)
    return out


def found(spark, corpus, requests, number=None):
    batch = [dict(qid=q, clauses=[term_range(**r) for r in clauses]) for q, clauses in enumerate(requests)]
    compiled = compile_requests(clause_requests(spark, batch))
    return {(r.qid, r[corpus.keys[-1]] if number is None else number[tuple(r[k] for k in corpus.keys)]): r.score
            for r in score_documents(corpus, compiled).collect()}


@pytest.mark.parametrize("most,literal", [(500_000, 256), (500_000, 0), (0, 0)])
def test_ranges_equal_brute_force(spark, monkeypatch, most, literal):
    monkeypatch.setattr(match_module, "BROADCAST_ROWS", most)
    monkeypatch.setattr(ranges_module, "LITERAL_BOUNDS", literal)
    rng = random.Random(most)
    rows = some_rows(rng, 60)
    requests = [[some_range(rng) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    assert found(spark, scan_corpus(documents(spark, rows)), requests) == expected(rows, requests)


class Counted(ScanCorpus):
    reads = []

    def terms_between(self, condition, fields):
        self.reads.append("terms")
        return super().terms_between(condition, fields)

    def postings_between(self, condition, fields):
        self.reads.append("postings")
        return super().postings_between(condition, fields)


def test_thousands_of_ranges_take_one_pass(spark):
    rng = random.Random(3)
    rows = some_rows(rng, 40)
    requests = [[some_range(rng) for _ in range(40)] for _ in range(60)]
    assert len({tuple(r.values()) for clauses in requests for r in clauses}) > 1_500
    corpus = Counted(scan_corpus(documents(spark, rows)).documents)
    Counted.reads.clear()
    assert found(spark, corpus, requests) == expected(rows, requests)
    # The distinct terms are read from the postings of a scanned corpus.
    assert sorted(Counted.reads) == ["postings", "postings", "terms"]


def test_ranges_on_a_store(spark, tmp_path):
    rng = random.Random(4)
    rows = some_rows(rng, 40)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    store.add_documents(documents(spark, rows).drop("doc_key"))
    store.delete_documents(spark.createDataFrame([(rows[0][0],), (rows[7][0],)], "id string"))
    corpus = store.snapshot()
    number = {(r.commit_seq, r.row_id): [x[0] for x in rows].index(r.id) for r in corpus.documents.collect()}
    requests = [[some_range(rng) for _ in range(2)] for _ in range(40)]
    want = {k: v for k, v in expected(rows, requests).items() if k[1] not in (0, 7)}
    assert found(spark, corpus, requests, number) == want


def test_a_wide_range_is_few_nodes(spark):
    spans = spark.createDataFrame([(a, b) for a in range(1, 70) for b in range(a, 70)], "first long, last long")
    for row in spans.withColumn("nodes", ranges_module.cover(F.col("first"), F.col("last"))).collect():
        covered = [s for n in row.nodes for s in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(covered) == list(range(row.first, row.last + 1))
        assert len(row.nodes) <= 2 * (row.last - row.first + 1).bit_length()


def test_spans_are_merged():
    spans = [dict(field="a", lower=x, upper=y) for x, y in [("c", "d"), (None, "b"), ("b", "bb"), ("é", "f"), ("x", None), ("y", "z")]]
    assert ranges_module.merged(spans) == [("a", None, "bb"), ("a", "c", "d"), ("a", "x", None)]
    apart = [dict(field="a", lower=f"{i:03}", upper=f"{i:03}") for i in range(100)]
    few = ranges_module.merged(apart, 7)
    assert len(few) == 7 and few[0][1] == "000" and few[-1][2] == "099"


def test_ranges_beside_other_clauses(spark):
    rows = [("a", "x", "p q"), ("b", "", "q r"), ("c", "", "s"), ("d", "", "")]
    batch = [
        [term_range("body", "q", "r", occur="must"), term("p", occur="must_not")],
        [term_range("body", "z", None), match_all()],
        [term_range("body", "r", "q", occur="must"), term("p")],
        [term_range("body", None, "q", occur="must_not"), match_all(boost=2)],
    ]
    compiled = compile_requests(clause_requests(spark, [dict(qid=n, clauses=c) for n, c in enumerate(batch)]))
    got = {}
    for r in score_documents(scan_corpus(documents(spark, rows)), compiled).collect():
        got.setdefault(r.qid, {})["abcd"[r.doc_key]] = r.score
    assert got == {0: {"b": 1.0}, 1: dict.fromkeys("abcd", 1.0), 3: {"c": 2.0, "d": 2.0}}
