"""A text is embedded once across documents, commits and requests."""

import sys
import tempfile
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from termloom import Store, clause_requests, search
from termloom.operators.embed import embed_queries, embed_texts
from termloom.sources import memo
from termloom.sources.memo import EmbeddingMemo, bloom_filter, text_digest

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class CountingModel:
    """Vectors of lengths and letters; notes each text that it sees in a file."""

    name = "counting"
    dims = 2

    def __init__(self, folder, bad=None):
        self.folder, self.bad = str(folder), bad

    def embed(self, texts):
        if self.bad is not None and self.bad in texts:
            raise ValueError("no vector")
        Path(self.folder, uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    def seen(self):
        return Counter(line for f in Path(self.folder).iterdir() for line in f.read_text().split("\n"))


@pytest.fixture
def folders():
    return [tempfile.mkdtemp(prefix="termloom-test-") for _ in range(3)]


@pytest.mark.parametrize("literals", [1_000, 0])
@pytest.mark.parametrize("filter_keys", [10_000, 0])
def test_each_text_once(spark, folders, monkeypatch, literals, filter_keys):
    monkeypatch.setattr(memo, "LITERAL_TERMS", literals)
    monkeypatch.setattr(memo, "FILTER_KEYS", filter_keys)
    model = CountingModel(folders[0])
    kept = EmbeddingMemo(model, folders[1])
    texts = [f"a text {i % 50}" for i in range(400)] + [None, "", "Ünïcode"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    first = {r.n: r.embedding for r in embed_texts(rows, kept).select("n", "embedding").collect()}
    assert first == {n: [float(len(t or "")), float((t or "").count("a"))] for n, t in enumerate(texts)}
    more = spark.createDataFrame([(1, "a text 7", "x"), (2, "new", "y"), (3, "new", "z")], "qid long, q string, digest string")
    again = EmbeddingMemo(model, folders[1] + "/")
    assert {r.qid: r.query_embedding for r in embed_queries(more, again).collect()} == {1: [8.0, 1.0], 2: [3.0, 0.0], 3: [3.0, 0.0]}
    made = embed_texts(more.withColumnRenamed("q", "text"), again, into="v")
    assert made.columns == ["qid", "text", "digest", "v"]
    assert made.count() == 3
    seen = model.seen()
    assert set(seen) == {t or "" for t in texts} | {"new"}
    assert set(seen.values()) == {1}
    assert kept.table(spark).count() == len(seen)


def test_empty_rows_and_other_models(spark, folders):
    model = CountingModel(folders[0])
    rows = spark.createDataFrame([(1, "a")], "n long, text string")
    assert embed_texts(rows.limit(0), EmbeddingMemo(model, folders[1])).collect() == []
    embed_texts(rows, EmbeddingMemo(model, folders[1])).collect()
    model.name = "another"
    embed_texts(rows, EmbeddingMemo(model, folders[1])).collect()
    assert model.seen()["a"] == 2


def test_failures_are_tried_again(spark, folders):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "n long, text string")
    kept = EmbeddingMemo(CountingModel(folders[0], bad="t3"), folders[1])
    got = {r.n: r.embedding for r in embed_texts(rows, kept, keep_failures=True).collect()}
    assert got[3] is None and all(got[n] for n in (0, 1, 2, 4))
    with pytest.raises(Exception, match="no vector"):
        embed_texts(rows, kept).collect()
    model = CountingModel(folders[0])
    got = {r.n: r.embedding for r in embed_texts(rows, EmbeddingMemo(model, folders[1])).collect()}
    assert got[3] == [2.0, 0.0]
    assert set(model.seen().values()) == {1}


def test_store_commits_and_requests_share(spark, folders):
    model = CountingModel(folders[0])
    kept = EmbeddingMemo(model, folders[1])
    store = Store(spark, folders[2], buckets=2)
    docs = spark.createDataFrame([(f"d{i}", "one title", f"body {i % 3}") for i in range(9)], "id string, title string, body string")
    store.add_documents(docs, embedder=kept)
    store.add_documents(docs.withColumn("id", F.concat("id", F.lit("x"))), embedder=kept)
    corpus = store.snapshot()
    assert corpus.vectors().count() == 18
    asked = clause_requests(spark, [dict(qid=i, q="body title", ai=True) for i in range(3)])
    hits = search(corpus, asked, corpus.vectors(), embedder=kept)
    again = search(corpus, asked, embedder=kept, embed_candidates=True)
    key = lambda r: (r.qid, r["rank"])
    columns = ["qid", "rank", "id", "score"]
    assert sorted(hits.select(*columns).collect(), key=key) == sorted(again.select(*columns).collect(), key=key)
    seen = model.seen()
    assert len(seen) == 4 and set(seen.values()) == {1}


def test_bloom_filter(spark):
    rows = spark.range(20_000).select(text_digest(F.col("id").cast("string")).alias("digest"), "id")
    held = rows.where("id % 4 = 0").select("digest")
    met = {r.id for r in rows.where(bloom_filter(held, 5_000)).collect()}
    assert met >= set(range(0, 20_000, 4))
    assert len(met) - 5_000 < 0.03 * 15_000
