import json
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from samples import Counting, Failing, FailingOn, documents
from termloom import clause_requests, knn, scan_corpus, search
from termloom.functions.vector import cosine
from termloom.operators import knn as knn_module
from termloom.operators.embed import Embedder, embed_texts, supports_scoring
from termloom.operators.rerank import fuse
from termloom.operators.vectors import check_dims, keep_dims, latest_vectors, vector_count
from termloom.plans.catalog import LengthScorer
from termloom.sources.vector_files import read_vector_object

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VECTORS = "id string, embedding array<float>"


def test_nearest(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.9, 0.1, 0.0])], VECTORS
    )
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, query_embedding array<float>")
    found = knn(vectors, queries, 2, 3).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in found] == [("a", 1), ("c", 2)]
    assert found[0].score == pytest.approx(1.0, abs=1e-6)


def test_wrong_dims(spark):
    bad = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None, 2.0])], VECTORS)
    assert keep_dims(bad, 3).count() == 0 and keep_dims(bad, 2).count() == 1
    with pytest.raises(Exception, match="dimension mismatch"):
        check_dims(bad, 3).collect()
    queries = spark.createDataFrame([(1, [1.0])], "qid long, query_embedding array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        knn(bad, queries, 1, 2).collect()


def test_cosine(spark):
    rows = [([1.0, 1.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])]
    pairs = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in pairs.select(cosine("a", "b")).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0], abs=1e-6)


def test_both_knn_plans_equal_brute_force_with_copies(spark, monkeypatch):
    """A third of the vectors are exact copies, so ties must be cut by id."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[200:] = data[0]
    data[5] = 0
    ids = [f"v{n:03}" for n in range(300)]
    vectors = spark.createDataFrame(
        [(i, v.tolist()) for i, v in zip(ids, data)], VECTORS
    ).repartition(5)
    asked = data[[0, 5, 17, 40, 250]]
    queries = spark.createDataFrame(
        [(n, v.tolist()) for n, v in enumerate(asked)], "qid long, query_embedding array<float>"
    )
    unit = lambda m: np.divide(
        m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros(m.shape), where=m.any(axis=1, keepdims=True)
    )
    scores = np.round(unit(asked.astype(float)) @ unit(data.astype(float)).T, 6) + 0.0
    expected = [
        (q, ids[j]) for q in range(5) for j in sorted(range(300), key=lambda j: (-scores[q, j], ids[j]))[:7]
    ]

    def run():
        return [(r.qid, r.id) for r in knn(vectors, queries, 7, 8).orderBy("qid", "rank").collect()]

    assert run() == expected
    monkeypatch.setattr(knn_module, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(knn_module, "QUERIES_PER_BLOCK", 2)
    monkeypatch.setattr(knn_module, "VECTORS_PER_BLOCK", 64)
    assert run() == expected


def test_latest_vector_wins(spark):
    history = spark.createDataFrame(
        [("i", "a", [1.0], 1), ("i", "a", [2.0], 2), ("i", "b", [3.0], 1), ("j", "a", [4.0], 1)],
        "index_name string, id string, embedding array<float>, n int",
    )
    live = latest_vectors(history, ["n"])
    assert sorted((r[0], r[1], r[2][0]) for r in live.collect()) == [
        ("i", "a", 2.0), ("i", "b", 3.0), ("j", "a", 4.0)
    ]
    assert vector_count(live).first().n == 3
    assert vector_count(live.limit(0)).first().is_empty


CANDIDATE = "qid int, bm25 double, bm25_rank int, ai boolean, ai_weight double, ai_score double, has_query_vector boolean"


def fused(spark, rows):
    table = spark.createDataFrame(rows, CANDIDATE)
    return [(r.bm25, r.score) for r in fuse(table).orderBy("qid", "rank").collect()]


def test_weight_zero_keeps_keyword_order(spark):
    rows = [(1, s, n, True, 0.0, 0.0, True) for n, s in enumerate((10.0, 5.0, 1.0), 1)]
    assert [b for b, _ in fused(spark, rows)] == [10.0, 5.0, 1.0]


def test_blend_values(spark):
    rows = [(1, 3.0, 1, True, 0.5, 0.8, True), (1, 1.0, 2, True, 0.5, 0.8, True)]
    assert fused(spark, rows) == [(3.0, 0.95), (1.0, 0.45)]
    # Weight is clamped, a missing score counts as 0.5, one candidate scales to 0.
    assert fused(spark, [(1, 3.0, 1, True, 7.0, None, True)]) == [(3.0, 0.5)]
    assert fused(spark, [(1, 3.0, 1, True, -1.0, 0.9, True)]) == [(3.0, 0.0)]
    assert fused(spark, []) == []
    # Without a query vector, or without being asked, the keyword score stays.
    assert fused(spark, [(1, 3.0, 1, True, 0.5, 0.8, False)]) == [(3.0, 3.0)]
    assert fused(spark, [(1, 3.0, 1, False, 0.5, 0.8, True)]) == [(3.0, 3.0)]


def test_embedding_in_calls_of_at_most_100(spark):
    texts = spark.range(0, 257, numPartitions=1).select(
        "id", F.concat(F.lit("tea "), F.col("id").cast("string")).alias("text")
    )
    made = embed_texts(texts, Counting()).collect()
    assert len(made) == 257 and all(r.embedding[:3] == [1.0, 1.0, 1.0] for r in made)
    assert isinstance(Counting(), Embedder) and not supports_scoring(Counting())
    assert supports_scoring(LengthScorer())


class Traced:
    """Notes the most memory that Python's objects took from its second call, when modules are loaded, to its call ``last``."""

    name = "traced"
    dims = 1

    def __init__(self, path, last):
        self.path, self.last, self.calls = str(path), last, 0

    def embed(self, texts):
        self.calls += 1
        if self.calls == 2:
            tracemalloc.start()
        elif self.calls == self.last:
            Path(self.path).write_text(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()
        return [[float(len(t))] for t in texts]


def test_worker_holds_the_texts_of_one_call(spark, tmp_path):
    texts = spark.range(0, 22_000, numPartitions=1).select("id", F.lpad(F.col("id").cast("string"), 2000, "tea ").alias("text"))
    made = embed_texts(texts, Traced(tmp_path / "peak", 220)).agg(F.count("embedding"), F.min("embedding"), F.max("embedding"))
    assert tuple(made.first()) == (22_000, [2000.0], [2000.0])
    # One of Spark's batches has 20 MB, read as one object; the texts of a call 0.2 MB.
    assert int((tmp_path / "peak").read_text()) < 32_000_000


def test_other_columns_of_any_kind_and_odd_vectors(spark):
    rows = spark.sql(
        """SELECT id, if(id % 3 = 0, NULL, concat('text ', id)) AS text, if(id % 2 = 0, NULL, cast(id AS INT)) AS n,
        timestamp_micros(id * 1000003) AS t, date_add(date'1969-12-30', cast(id AS INT)) AS d, cast(id / 7 AS DECIMAL(20, 5)) AS x,
        array(id, NULL) AS a, map(id, named_struct('s', array('u', NULL))) AS m, unhex('00ff') AS b, cast(NULL AS VOID) AS v
        FROM range(0, 250, 1, 1)"""
    )

    class Odd:
        name, dims = "odd", 3

        def embed(self, texts):
            return [np.array([0.1, float("inf"), -1.0 if t is None else len(t)]) for t in texts]

    made = embed_texts(rows, Odd())
    assert made.columns == [*rows.columns, "embedding"]
    assert sorted(made.drop("embedding").collect()) == sorted(rows.collect())
    for r in made.collect():
        assert r.embedding == [float(np.float32(0.1)), float("inf"), -1.0 if r.text is None else len(r.text)]
    assert embed_texts(rows.limit(0), Odd()).collect() == []


def test_failing_model(spark):
    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    assert embed_texts(texts, Failing(), keep_failures=True).first().embedding is None
    with pytest.raises(Exception, match="model is down"):
        embed_texts(texts, Failing()).collect()
    # A search whose query cannot be embedded keeps its keyword ranking.
    docs = scan_corpus(documents(spark, [("1", "tea", "tea time"), ("2", "", "tea")]))
    asked = clause_requests(spark, [dict(qid=1, q="tea", ai=True)])
    plain = search(docs, clause_requests(spark, [dict(qid=1, q="tea")]))
    broken = search(docs, asked, embedder=Failing(), embed_candidates=True)
    columns = ["rank", "id", "score"]
    assert broken.select(columns).collect() == plain.select(columns).collect()


def test_failing_candidate_keeps_keyword_order(spark):
    docs = scan_corpus(documents(spark, [("1", "tea", "tea time"), ("2", "", "tea cup zebra"), ("3", "", "tea pot"), ("4", "", "milk jug")]))
    asked = [dict(qid=1, q="tea", ai=True, ai_weight=1.0), dict(qid=2, q="milk", ai=True, ai_weight=1.0)]
    got = search(docs, clause_requests(spark, asked), embedder=FailingOn("zebra"), embed_candidates=True)
    plain = search(docs, clause_requests(spark, [dict(qid=1, q="tea")]))
    columns = ["rank", "id", "score"]
    assert got.where("qid = 1").select(columns).collect() == plain.select(columns).collect()
    milk = [r for r in got.collect() if r.qid == 2]
    assert len(milk) == 1 and milk[0].score <= 1.0


def test_one_bad_text_costs_no_other(spark):
    texts = spark.createDataFrame([(n, "zebra" if n in (3, 250) else f"text {n}") for n in range(300)], "id int, text string")
    rows = embed_texts(texts.coalesce(1), FailingOn("zebra"), keep_failures=True).collect()
    assert {r.id for r in rows if r.embedding is None} == {3, 250}


def test_vector_object_file(spark, tmp_path):
    wanted = {f'k"{n}': [float(n), -1.5] for n in range(50)} | {"x]y": [1.0, 2.0]}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(wanted, separators=(",", ":")))
    got = {r.id: r.embedding for r in read_vector_object(spark, str(path)).collect()}
    assert got == wanted
    odd = {"{650e}": [1.0], " lead ": [2.0], "a],": [3.0], "}": [], '"],"': [4.0], ":[3": [5.0], "": [6.0]}
    path.write_text(json.dumps(odd, indent=1))
    assert {r.id: r.embedding for r in read_vector_object(spark, str(path)).collect()} == odd
    for bad in ('{"a":[1.0],"b":2}', '{"a":[1.0, null]}', '{"a":null}', '["a"]', '{"a":[1.0]'):
        path.write_text(bad)
        with pytest.raises(Exception):
            read_vector_object(spark, str(path)).collect()


def test_vector_object_read_by_several_tasks(spark, tmp_path, monkeypatch):
    """Blocks of 300 bytes: ids with brackets, quotes and escapes lie across their ends."""
    marks = ["]", '"],"', "\\", '\\"]', "]]]:[", "é]", "{", "},", ""]
    wanted = {f"{marks[n % len(marks)] * (1 + n % 4)}{n}": [float(n), -0.5] for n in range(400)}
    wanted |= {"]" * 700: [1.0], '"]' * 400: [2.0]}
    (tmp_path / "one.json").write_text(json.dumps(wanted))
    (tmp_path / "two.json").write_text(json.dumps({"only": [7.0]}, indent=2) + "\n")
    (tmp_path / "three.json").write_text(" {\n} ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300", "1000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            text = spark.read.option("lineSep", "]").text(str(tmp_path / "one.json"))
            assert size == before or text.select("_metadata.file_block_start").distinct().count() > 5
            got = read_vector_object(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(got) == len(wanted) + 1
        assert {r.id: r.embedding for r in got} == wanted | {"only": [7.0]}


@pytest.mark.parametrize("bad", ["", " ", '{"a":[1.0]}}', '{"a":[1.0]"b":[2.0]}', '{"a":[1.0],}', '{"a":[[1.0]]}', '{"a]:[1.0]}', "{", "}"])
def test_no_vector_object(spark, tmp_path, bad):
    path = tmp_path / "v.json"
    path.write_text(bad)
    if not bad:
        assert read_vector_object(spark, str(path)).collect() == []
        return
    with pytest.raises(Exception):
        read_vector_object(spark, str(path)).collect()
