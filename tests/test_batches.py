"""Batches of plain words: scoring in blocks, and leaving out hopeless documents, against scoring all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import termloom.operators.blocks as blocks_module
import termloom.operators.clauses as clauses_module
import termloom.operators.match as match_module
import termloom.session as session_module
from samples import documents
from termloom.operators.blocks import best_of_block
from termloom.operators.clauses import clause_requests, compile_requests, term
from termloom.operators.match import fan_out, keyword_pool, valued_postings
from termloom.operators.postings import build_postings, scan_corpus, with_field_totals
from termloom.operators.pruning import pruned_scores
from termloom.session import scratch_table
from termloom.sources.store import Store


def some_rows(rng, n):
    """Texts where some words are everywhere and most are rare; every fifth is a copy."""
    rows = []
    for i in range(n):
        body = " ".join(f"w{int(rng.random() ** 4 * 400)}" for _ in range(rng.randint(0, 40)))
        rows.append((str(i), f"w{rng.randint(0, 30)}", rows[i - 1][2] if i % 5 == 4 else body))
    return rows


def some_requests(rng, n, words):
    return [
        dict(qid=q, q=" ".join(f"w{int(rng.random() ** 3 * 420)}" for _ in range(rng.randint(0, words))), limit=rng.randint(1, 4))
        for q in range(n)
    ] + [dict(qid=n, q=None), dict(qid=n + 1, q="w0 w0 w1"), dict(qid=n + 2, q="w0", index_name="other")]


def pool(corpus, compiled, **options):
    rows = keyword_pool(corpus, compiled, **options).collect()
    return sorted((r.qid, r.bm25_rank, *(r[k] for k in corpus.keys), r.bm25) for r in rows)


@pytest.mark.parametrize("cells", [4_000_000, 3_000])
def test_blocks_give_the_same_pools(spark, monkeypatch, cells):
    rng = random.Random(cells)
    corpus = scan_corpus(documents(spark, some_rows(rng, 700)))
    compiled = compile_requests(clause_requests(spark, some_requests(rng, 40, 12)))
    want = pool(corpus, compiled)
    assert len({r[0] for r in want}) > 30
    monkeypatch.setattr(match_module, "BLOCK_TERMS", 0)
    monkeypatch.setattr(blocks_module, "CELLS", cells)
    assert pool(corpus, compiled) == want
    assert pool(corpus, compiled, prune=True) == want


def test_blocks_on_a_store_with_deletes_and_on_text_keys(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    rows = some_rows(rng, 120)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    store.add_documents(documents(spark, rows).drop("doc_key"))
    store.delete_documents(spark.createDataFrame([(str(i),) for i in range(0, 120, 7)], "id string"))
    compiled = compile_requests(clause_requests(spark, some_requests(rng, 15, 8)))
    named = scan_corpus(documents(spark, rows).withColumn("name", F.concat(F.lit("d"), "doc_key")), keys=["name"])
    corpora = [store.snapshot(), named, scan_corpus(documents(spark, []))]
    want = [pool(c, compiled) for c in corpora]
    monkeypatch.setattr(match_module, "BLOCK_TERMS", 0)
    assert [pool(c, compiled) for c in corpora] == want
    assert [pool(c, compiled, prune=True) for c in corpora] == want
    assert want[0] and want[1] and not want[2]


def test_other_requests_are_scored_in_full(spark):
    """Negative boosts, which no bound holds for, and clauses that are not plain words."""
    corpus = scan_corpus(documents(spark, some_rows(random.Random(5), 80)))
    for clauses in ([term("w0", boost=-1), term("w1", boost=3)], [term("w0", occur="must"), term("w1")]):
        compiled = compile_requests(clause_requests(spark, [dict(qid=1, clauses=clauses)]))
        assert pool(corpus, compiled, prune=True) == pool(corpus, compiled) != []


def test_documents_of_frequent_words_alone_are_not_scored(spark):
    rng = random.Random(7)
    rows = [(str(i), "", "the of " + ("zebra " * 3 if i % 50 == 0 else "") + " ".join(f"x{rng.randint(0, 99)}" for _ in range(20))) for i in range(1_500)]
    corpus = scan_corpus(documents(spark, rows))
    compiled = compile_requests(clause_requests(spark, [dict(qid=q, q="zebra the of", limit=5) for q in range(4)]))
    postings = corpus.settled(corpus.postings_for(compiled))
    weights = with_field_totals(corpus.statistics_for(compiled, postings))
    valued = scratch_table(valued_postings(postings, weights, corpus.keys, True))
    pools = compiled.requests.select("qid", (F.col("limit") * 2).alias("pool"))
    fan = lambda p, t: fan_out(p, t, corpus.keys, True)
    found = pruned_scores(valued, compiled.terms.select("qid", "index_name", "field", "term", "boost"), pools, corpus.keys, 10, fan, True)
    every = found.asked.agg(F.sum("df")).first()[0]
    needed = found.asked.where("needed").agg(F.sum("df")).first()[0]
    scored = needed + found.lookups.count()
    assert every == 4 * (1_500 + 1_500 + 30) and scored < every / 10
    assert pool(corpus, compiled, prune=True) == pool(corpus, compiled)


def test_best_of_a_block_against_a_plain_product():
    rng = np.random.default_rng(3)
    terms, documents_, requests = 30, 50, 9
    worth = rng.random((terms, documents_)) * (rng.random((terms, documents_)) < 0.4)
    boost = rng.integers(0, 3, (requests, terms)).astype(float)
    t, d = np.nonzero(worth)
    mix = rng.permutation(len(t))
    who = [np.flatnonzero(boost[:, i]) for i in range(terms)]
    asked = (np.concatenate(who), np.concatenate([boost[w, i] for i, w in enumerate(who)]), np.cumsum([0, *map(len, who)]))
    for few, cells in ((1_000, 4_000_000), (0, 4_000_000), (20, 120)):
        blocks_module.FEW_PAIRS, blocks_module.CELLS, saved = few, cells, (blocks_module.FEW_PAIRS, blocks_module.CELLS)
        q, k, score = best_of_block(d[mix], t[mix], worth[t, d][mix], asked, requests, 5)
        blocks_module.FEW_PAIRS, blocks_module.CELLS = saved
        full = boost @ worth
        for i in range(requests):
            got = dict(zip(k[q == i].tolist(), score[q == i].tolist()))
            best = np.sort(full[i][full[i] > 0])[-5:]
            assert got == pytest.approx({j: full[i, j] for j in got}) and sorted(got.values()) == pytest.approx(best.tolist())


@pytest.mark.parametrize("few", [500_000, 0])
def test_requests_too_many_to_broadcast_are_answered_in_passes(spark, monkeypatch, tmp_path, few):
    """Each pass holds some requests only; no (request, document) pair becomes a row of its own."""
    rng = random.Random(11)
    rows = some_rows(rng, 150)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    store.add_documents(documents(spark, rows).drop("doc_key"))
    store.delete_documents(spark.createDataFrame([(str(i),) for i in range(0, 150, 7)], "id string"))
    requests = clause_requests(spark, some_requests(rng, 15, 12) + [dict(qid=None, q="w0 w1")])
    corpora = [store.snapshot(), scan_corpus(documents(spark, rows))][: 2 if few else 1]
    want = [pool(c, compile_requests(requests)) for c in corpora]
    assert all(want)

    def refuse(*args):
        raise AssertionError("all matches scored")

    monkeypatch.setattr(match_module, "score_documents", refuse)
    monkeypatch.setattr(match_module, "BLOCK_TERMS", 0)
    monkeypatch.setattr(match_module, "fits_broadcast", lambda compiled: False)
    monkeypatch.setattr(match_module, "BROADCAST_ROWS", few)
    monkeypatch.setattr(blocks_module, "ROWS_AT_ONCE", 120)
    monkeypatch.setattr(blocks_module, "MOST_DOCUMENTS", 100)
    monkeypatch.setattr(clauses_module, "LOCAL_ROWS", 0)
    assert [pool(c, compile_requests(requests)) for c in corpora] == want


def test_requests_without_an_id_are_left_out(spark, monkeypatch):
    corpus = scan_corpus(documents(spark, some_rows(random.Random(14), 30)))
    compiled = compile_requests(clause_requests(spark, [dict(qid=q, q="w0 w1") for q in (None, 5)]))
    want = pool(corpus, compiled)
    monkeypatch.setattr(match_module, "BLOCK_TERMS", 0)
    assert pool(corpus, compiled) == want and {r[0] for r in want} == {5}


def test_tasks_hold_as_much_however_long_the_texts_are(spark, monkeypatch):
    rows = some_rows(random.Random(12), 200)
    corpus = scan_corpus(documents(spark, rows))
    assert corpus.partitions is None
    docs = corpus.documents
    want = sorted(map(str, build_postings(docs, ["doc_key"]).collect()))
    monkeypatch.setattr(session_module, "TASK_TEXT", 1_000)
    compiled = compile_requests(clause_requests(spark, some_requests(random.Random(13), 20, 6)))
    expected = pool(corpus, compiled)
    cut = scan_corpus(documents(spark, rows))
    size = sum(len(text) for row in rows for text in row[1:])
    assert cut.partitions == -(-size // 1_000) > 8
    assert cut.postings_for(compiled).rdd.getNumPartitions() == cut.partitions
    made = build_postings(docs, ["doc_key"])
    assert made.rdd.getNumPartitions() == cut.partitions and sorted(map(str, made.collect())) == want
    assert pool(cut, compiled) == expected


@pytest.mark.parametrize("cells,most,pool", [(4_000_000, 40, 3), (600, 7, 2), (20, 200, 5), (4_000_000, 200, 300)])
def test_a_task_leaves_the_best_of_all_its_documents(spark, monkeypatch, cells, most, pool):
    """Also of later ones: what earlier documents held is not written, and scores are those of a plain product."""
    rng = np.random.default_rng(most)
    documents_, requests, terms = 200, 30, 50
    worth = rng.random((documents_, terms)) * (rng.random((documents_, terms)) < 0.3)
    worth *= np.arange(1, documents_ + 1)[:, None] ** 0.5  # later documents are better
    worth[50:60] = worth[190]  # copies
    boost = rng.integers(0, 3, (requests, terms)) * (rng.random((requests, terms)) < 0.4)
    boost[4] = 0
    # A key that comes twice has a term twice: the worth of both adds up.
    held = [[(int(t) * 7 + 1, w) for t, w in enumerate(row) if w] for row in worth]
    held[9] = [(t, w / 2) for t, w in held[9] for _ in range(2)]
    packed = spark.createDataFrame([(i, [t for t, _ in h], [float(w) for _, w in h]) for i, h in enumerate(held)], "doc_key long, numbers array<long>, worths array<double>")
    asked = spark.createDataFrame([(int(q) + 100, int(t) * 7 + 1, float(boost[q, t])) for q, t in zip(*np.nonzero(boost))], "qid long, term_number long, boost double")
    monkeypatch.setattr(blocks_module, "CELLS", cells)
    monkeypatch.setattr(blocks_module, "MOST_DOCUMENTS", most)
    monkeypatch.setattr(blocks_module, "ROWS_AT_ONCE", 300)
    found = blocks_module.passes_scores(scratch_table(packed.coalesce(1)), asked, asked.count(), ["doc_key"], pool).collect()
    full = boost @ worth.T
    got = {}
    for row in found:
        assert row.score == pytest.approx(full[row.qid - 100, row.doc_key], rel=1e-12)
        got.setdefault(row.qid - 100, {})[row.doc_key] = row.score
    for q in range(requests):
        best = np.sort(full[q][full[q] > 0])[::-1][:pool]
        mine = sorted(got.get(q, {}).values(), reverse=True)
        assert mine[:pool] == pytest.approx(best.tolist(), rel=1e-12)
        if cells == 4_000_000:
            assert all(s >= best[-1] - 1e-6 for s in mine)
