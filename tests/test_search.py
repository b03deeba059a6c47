import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samples import SEEDS, bm25, documents
from termloom import (
    clause_requests,
    compile_requests,
    match_all,
    phrase,
    response,
    scan_corpus,
    search,
    term,
    term_range,
    term_set,
)
from termloom.operators import clauses as clause_module
from termloom.operators import match as match_module
from termloom.operators.clauses import validate
from termloom.operators.match import score_documents
from termloom.schema import CLAUSE

# The known-answer case of two documents.
PAIR = [
    ("1", "Rust programming", "systems language with memory safety"),
    ("2", "Python scripting", "dynamic language for data science"),
]


def hits(spark, rows, *requests, **options):
    table = clause_requests(spark, [dict(qid=n, **r) for n, r in enumerate(requests)])
    found = search(scan_corpus(documents(spark, rows)), table, **options)
    return [(r.qid, r.id, r.score) for r in found.orderBy("qid", "rank").collect()]


def test_word_finds_its_document_first(spark):
    assert hits(spark, PAIR, dict(q="rust", limit=10))[0][1] == "1"


def test_no_match_gives_nothing(spark):
    assert hits(spark, [("1", "Hello world", "some text")], dict(q="xylophone")) == []
    assert hits(spark, PAIR, dict(q=""), dict(q="... !")) == []


def test_scores_equal_plain_python(spark):
    queries = ["programming language", "how do search engines find documents",
               "rust rust safety", "Web BUILDING"]
    found = hits(spark, SEEDS, *[dict(q=q) for q in queries])
    for n, q in enumerate(queries):
        expected = bm25(SEEDS, q)
        mine = {i: s for qid, i, s in found if qid == n}
        assert mine == pytest.approx(expected, abs=2e-6)


def test_limit_and_order(spark):
    found = hits(spark, SEEDS, dict(q="the and", limit=2))
    best = sorted(bm25(SEEDS, "the and").values(), reverse=True)[:2]
    assert [s for *_, s in found] == pytest.approx(best, abs=2e-6)
    assert len(hits(spark, SEEDS, dict(q="the and", limit=4), max_results=1)) == 1
    with pytest.raises(ValueError):
        clause_requests(spark, [dict(qid=1, q="a", limit=0)])
    bad = spark.createDataFrame([(1, "a", 0)], "qid long, q string, limit int")
    with pytest.raises(ValueError):
        compile_requests(bad)


def test_equal_ids_are_separate_hits(spark):
    assert len(hits(spark, [PAIR[0], PAIR[0]], dict(q="rust"))) == 2


def expect(spark, rows, cases):
    """Run all cases as one batch; each is (clauses, expected ids)."""
    found = {n: [] for n in range(len(cases))}
    for qid, doc, _ in hits(spark, rows, *[dict(clauses=c, limit=100) for c, _ in cases]):
        found[qid].append(doc)
    assert [sorted(found[n]) for n in found] == [e for _, e in cases]


def test_boolean_clauses(spark):
    rows = [("a", "", "x y"), ("b", "", "x z"), ("c", "", "y z"), ("d", "x", "w")]
    must, no = dict(occur="must"), dict(occur="must_not")
    expect(
        spark,
        rows,
        [
            ([term("x", **must), term("z", **must)], ["b"]),
            ([term("x"), term("y", **no)], ["b", "d"]),
            ([term("x", **must), term("y")], ["a", "b", "d"]),
            ([term("x", field="title")], ["d"]),
            ([term("b", field="id"), term("c", field="id")], ["b", "c"]),
            ([match_all()], ["a", "b", "c", "d"]),
            ([match_all(**must), term("x", **no)], ["c"]),
            ([term_set(["y", "w"])], ["a", "c", "d"]),
            ([term_range("body", "y", None)], ["a", "b", "c"]),
            ([term_range("body", "w", "x", incl_upper=False)], ["d"]),
            ([term("x", **must), term_set([], **must)], []),
            ([term_range("id", "b", "c")], ["b", "c"]),
        ],
    )


def test_more_must_clauses_than_mask_bits(spark):
    names = [f"w{n}" for n in range(70)]
    rows = [("all", "", " ".join(names)), ("most", "", " ".join(names[1:]))]
    expect(spark, rows, [([term(n, occur="must") for n in names], ["all"])])


def test_phrases(spark):
    rows = [
        ("abc", "", "a b c"),
        ("axbc", "", "a x b c"),
        ("axbxc", "", "a x b x c"),
        ("ba", "", "b a"),
        ("split", "a", "b c"),
    ]
    expect(
        spark,
        rows,
        [
            ([phrase("a b c")], ["abc"]),
            ([phrase("a b c", slop=1)], ["abc", "axbc"]),
            ([phrase("a b c", slop=2)], ["abc", "axbc", "axbxc"]),
            ([phrase("a b", slop=1)], ["abc", "axbc", "axbxc"]),
            ([phrase("a b", slop=2)], ["abc", "axbc", "axbxc", "ba"]),
            # One word of several tokens is a phrase.
            ([term("b-c")], ["abc", "axbc", "split"]),
        ],
    )


def test_phrase_repeated_word_and_gap(spark):
    long_word = "x" * 45
    rows = [("r", "", "the the the"), ("g", "", f"a {long_word} b"), ("n", "", "a b")]
    expect(
        spark,
        rows,
        [
            ([phrase("the the")], ["r"]),
            ([phrase("a b")], ["n"]),
            ([phrase(f"a {long_word} b")], ["g"]),
        ],
    )


def test_slop_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(str(n), "", " ".join(rng.choice("abcd") for _ in range(12))) for n in range(30)]

    def occurs(body, parts, slop):
        tokens = body.split()
        reached = {p: 0 for p, t in enumerate(tokens) if t == parts[0]}
        for i, part in enumerate(parts[1:], 1):
            nxt = {}
            for p, t in enumerate(tokens):
                costs = [c + abs((p - i) - s) for s, c in reached.items() if t == part]
                if costs and min(costs) <= slop:
                    nxt[p - i] = min(costs)
            reached = nxt
        return bool(reached)

    cases = []
    for text, slop in (("a b", 1), ("a b c", 2), ("b b a", 3)):
        expected = sorted(r[0] for r in rows if occurs(r[2], text.split(), slop))
        cases.append(([phrase(text, slop=slop)], expected))
    expect(spark, rows, cases)


def test_boost_multiplies(spark):
    plain = dict((i, s) for _, i, s in hits(spark, SEEDS, dict(clauses=[term("rust")])))
    tripled = dict((i, s) for _, i, s in hits(spark, SEEDS, dict(clauses=[term("rust", boost=3)])))
    assert tripled == pytest.approx({i: 3 * s for i, s in plain.items()}, abs=1e-5)


def test_bad_clauses_are_errors():
    for field in ("url", "metadata", "nosuch"):
        with pytest.raises(ValueError):
            term("x", field=field)
    with pytest.raises(ValueError):
        validate([term("x", occur="must_not")])
    with pytest.raises(ValueError):
        term_range("body")
    with pytest.raises(ValueError):
        phrase("a b", slop=-1)


MIXED = [
    dict(q="rust safety the-language"),
    dict(clauses=[term("the", occur="must"), term("rust", occur="must_not")]),
    dict(clauses=[phrase("memory safety"), term_set(["python", "axum"])]),
    dict(clauses=[term_range("body", "sa", "sz"), match_all()]),
    dict(clauses=[term_range("id", "rust-notes", "vector-atlas", incl_lower=False)]),
    dict(clauses=[term_range(None, None, "all"), term_range("title", "we", None)]),
]


def scores(spark, corpus):
    requests = clause_requests(spark, [dict(qid=n, **r) for n, r in enumerate(MIXED)])
    found = score_documents(corpus, compile_requests(requests)).collect()
    return sorted((r.qid, r.doc_key, r.score) for r in found)


BAD_CLAUSES = {
    "kind": dict(kind="prefix"),
    "no kind": dict(kind=None),
    "occur": dict(occur="maybe"),
    "field": dict(field="url"),
    "boost": dict(boost=None),
    "slop": dict(kind="phrase", slop=-1),
    "text": dict(text=None),
    "bounds": dict(kind="range"),
    "terms": dict(kind="set"),
    "only negative": dict(occur="must_not"),
}


@pytest.mark.parametrize("limit", [0, clause_module.LOCAL_ROWS])
@pytest.mark.parametrize("name", BAD_CLAUSES)
def test_bad_clause_tables_fail_in_both_forms(spark, monkeypatch, name, limit):
    monkeypatch.setattr(clause_module, "LOCAL_ROWS", limit)
    good = clause_requests(spark, [dict(qid=1, clauses=[term("tea")]), dict(qid=2, q="tea")])
    row = dict(term("tea")) | BAD_CLAUSES[name]
    bad = spark.createDataFrame([(77, None, [tuple(row[n] for n in CLAUSE.names)])], T.StructType([good.schema[c] for c in ("qid", "q", "clauses")]))
    requests = good.select("qid", "q", "clauses").union(bad)
    corpus = scan_corpus(documents(spark, SEEDS))
    with pytest.raises(Exception, match="request 77"):
        search(corpus, requests).collect()
    assert search(corpus, requests.where("qid < 77")).count() == 0


def test_large_batch_paths_agree(spark, monkeypatch):
    """Distributed compilation and the salted join give what the small path gives."""
    corpus = scan_corpus(documents(spark, SEEDS))
    small = scores(spark, corpus)
    assert small
    monkeypatch.setattr(clause_module, "LOCAL_ROWS", 0)
    assert scores(spark, corpus) == small
    monkeypatch.setattr(match_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(match_module, "SALTS", 3)
    assert scores(spark, corpus) == small


def test_batch_equals_single_queries_and_partitioning_is_irrelevant(spark):
    docs = documents(spark, SEEDS)
    together = scores(spark, scan_corpus(docs))
    apart = []
    for n, request in enumerate(MIXED):
        table = clause_requests(spark, [dict(qid=n, **request)])
        found = score_documents(scan_corpus(docs.repartition(7)), compile_requests(table))
        apart += [(r.qid, r.doc_key, r.score) for r in found.collect()]
    assert sorted(apart) == together


def test_scope(spark):
    docs = documents(spark, SEEDS).withColumn(
        "index_name", F.when(F.col("id").startswith("rust"), "a").otherwise("b")
    )
    requests = clause_requests(
        spark, [dict(qid=n, q="rust", index_name=i) for n, i in enumerate("abx")]
    )
    found = search(scan_corpus(docs), requests).collect()
    assert sorted((r.qid, r.id) for r in found) == [(0, "rust-notes"), (1, "web-kitchen")]


def test_response_keeps_requests_without_hits(spark):
    requests = clause_requests(
        spark, [dict(qid=1, q="rust", ai=True), dict(qid=2, q="xylophone"), dict(qid=3, q=None)]
    )
    found = search(scan_corpus(documents(spark, SEEDS)), requests)
    rows = {r.qid: r for r in response(requests, found, ai_available=True).collect()}
    assert [h.id for h in rows[1].hits] == ["rust-notes", "web-kitchen"]
    assert rows[1].ai_enabled and not rows[2].ai_enabled
    assert rows[2].hits == [] and rows[3].hits == []
