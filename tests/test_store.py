import pytest
from pyspark.sql import functions as F

from samples import SEEDS, Failing, FailingOn, documents
from termloom import session as session_module
from termloom import Store, clause_requests, ingest_stream, scan_corpus, search, search_stream
from termloom.operators.clauses import compile_requests
from termloom.operators.match import keyword_pool
from termloom.plans.catalog import LetterModel
from termloom.sources import store as store_module
from termloom.sources.documents import from_storage, read_documents, read_documents_apart, to_storage
from termloom.sources.store import one_of


def found(corpus, spark, *queries, **options):
    requests = clause_requests(spark, [dict(qid=n, q=q) for n, q in enumerate(queries)])
    rows = search(corpus, requests, **options).orderBy("qid", "rank").collect()
    return [(r.qid, r.id, r.score) for r in rows]


def ids_frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=3, dims=8)


def test_life_of_a_document(spark, store):
    assert found(store.snapshot(), spark, "zephyr") == []
    rows = [("1", "Unique zephyr title", "unique zephyr body", "https://example.com"),
            ("", "No id", "gets one")]
    assert store.add_documents(documents(spark, rows)) == 2
    first = store.snapshot()
    assert [h[1] for h in found(first, spark, "zephyr")] == ["1"]
    stored = search(first, clause_requests(spark, [dict(qid=1, q="zephyr")])).first()
    assert stored.url == "https://example.com" and stored.metadata is None
    made = first.documents.where("title = 'No id'").first()
    assert len(made.id) == 36

    assert store.delete_documents(ids_frame(spark, "1", "nosuch")) == 1
    assert found(store.snapshot(), spark, "zephyr") == []
    assert [h[1] for h in found(first, spark, "zephyr")] == ["1"]

    store.add_documents(documents(spark, rows[:1]))
    again = store.snapshot()
    assert [h[1] for h in found(again, spark, "zephyr")] == ["1"]
    assert again.get(ids_frame(spark, "1").withColumn("index_name", F.lit("default"))).count() == 1
    assert [r.index_name for r in store.list_indexes().collect()] == ["default"]
    assert found(store.snapshot(index_name="nosuch"), spark, "zephyr") == []


def test_statistics_after_delete_equal_a_fresh_corpus(spark, store):
    store.add_documents(documents(spark, SEEDS[:3]))
    store.add_documents(documents(spark, SEEDS[2:]))
    store.delete_documents(ids_frame(spark, "library-search"))
    left = [s for s in SEEDS if s[0] != "library-search"]
    queries = ("rust safety the", "vector databases", "machine-learning")
    expected = found(scan_corpus(documents(spark, left)), spark, *queries)
    assert found(store.snapshot(), spark, *queries) == expected


def test_unfinished_commit_is_invisible_and_its_number_is_not_reused(spark, store):
    store.add_documents(documents(spark, SEEDS[:2]))
    seq = store._begin("add")
    half = documents(spark, SEEDS[2:]).withColumn("row_id", F.monotonically_increasing_id())
    store._insert("documents", to_storage(half).withColumn("row_id", F.lit(7).cast("long")), seq)
    store.add_documents(documents(spark, SEEDS[3:4]))
    snapshot = store.snapshot()
    assert snapshot.seq == seq + 1 and snapshot.open_commits == (seq,)
    assert snapshot.documents.count() == 3


def test_store_reopens_in_a_session_without_its_tables(spark, store):
    store.add_documents(documents(spark, SEEDS))
    expected = found(store.snapshot(), spark, "rust safety")
    for name in ("documents", "postings", "term_stats", "deleted", "vectors"):
        spark.sql(f"DROP TABLE {store.table_name(name)}")
    reopened = Store(spark, store.root, buckets=99)
    assert reopened.buckets == 3
    assert found(reopened.snapshot(), spark, "rust safety") == expected


def test_scoring_does_not_shuffle_postings(spark, store):
    store.add_documents(documents(spark, SEEDS))
    requests = clause_requests(spark, [dict(qid=1, q="rust safety")])
    pool = keyword_pool(store.snapshot(), compile_requests(requests))
    pool.collect()
    plan = pool._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if "FileScan" in line and "_postings" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    shuffles = [line for line in above if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "hashpartitioning(qid" in shuffles[0]
    assert "In(term" in plan or "term#" in plan and "IN (" in plan


def test_vectors(spark, store):
    made = "id string, embedding array<float>"
    good, bad = [1.0] * 8, [1.0] * 3
    assert store.put_vectors(spark.createDataFrame([("a", good), ("b", good), ("c", bad)], made)) == 2
    store.put_vectors(spark.createDataFrame([("a", [2.0] * 8)], made))
    with pytest.raises(Exception, match="dimension mismatch"):
        store.put_vectors(spark.createDataFrame([("a", bad)], made), strict=True)
    live = {r.id: r.embedding[0] for r in store.snapshot().vectors().collect()}
    assert live == {"a": 2.0, "b": 1.0}
    gone = store.delete_vectors(ids_frame(spark, "a", "x")).collect()
    assert sorted((r.id, r.deleted) for r in gone) == [("a", True), ("x", False)]
    assert [r.id for r in store.snapshot().vectors().collect()] == ["b"]


def test_embedding_follows_the_documents(spark, store):
    store.add_documents(documents(spark, SEEDS[:2]), embedder=LetterModel())
    store.add_documents(documents(spark, SEEDS[2:3]), embedder=Failing())
    snapshot = store.snapshot()
    assert snapshot.documents.count() == 3
    live = {r.id: r.embedding for r in snapshot.vectors().collect()}
    text = SEEDS[0][1] + " " + SEEDS[0][2]
    assert live.keys() == {"rust-notes", "herb-garden"}
    assert live["rust-notes"] == LetterModel().embed([text])[0]
    asked = clause_requests(spark, [dict(qid=1, q="safety language", ai=True, ai_weight=0.9)])
    hits = search(snapshot, asked, snapshot.vectors(), embedder=LetterModel())
    assert {r.id for r in hits.collect()} == {"rust-notes", "herb-garden"}


def test_missing_vectors_are_filled(spark, store):
    store.add_documents(documents(spark, SEEDS), embedder=FailingOn("herbs"))
    assert store.snapshot().vectors().count() == len(SEEDS) - 1
    assert store.fill_vectors(FailingOn("herbs")) == 0
    assert store.fill_vectors(LetterModel()) == 1
    live = {r.id: r.embedding for r in store.snapshot().vectors().collect()}
    assert live == {s[0]: LetterModel().embed([f"{s[1]} {s[2]}"])[0] for s in SEEDS}


def test_a_fill_that_fails_is_no_result(spark, store, monkeypatch):
    """A lost job raises; it does not return 0, as a store without gaps does."""
    insert = Store._insert

    def lost(self, name, rows, seq):
        if name == "vectors":
            raise OSError("disk is gone")
        insert(self, name, rows, seq)

    monkeypatch.setattr(Store, "_insert", lost)
    assert store.add_documents(documents(spark, SEEDS), embedder=LetterModel()) == len(SEEDS)
    with pytest.raises(OSError, match="disk is gone"):
        store.fill_vectors(LetterModel())
    monkeypatch.undo()
    assert store.snapshot().vectors().count() == 0
    assert store.fill_vectors(LetterModel()) == len(SEEDS)
    assert store.fill_vectors(LetterModel()) == 0


def test_no_vector_at_all_is_a_finished_commit(spark, store):
    """Without a row, Spark leaves the counting out of the plan; that is not a failed write."""
    store.add_documents(documents(spark, SEEDS[:2]))
    assert store.fill_vectors(Failing()) == 0
    assert store.put_vectors(spark.createDataFrame([], "id string, embedding array<float>")) == 0
    assert store.snapshot().open_commits == () and store.log().where("done and kind = 'vectors'").count() == 2


def test_replayed_batch_makes_missing_vectors(spark, store, tmp_path):
    source = str(tmp_path / "in")
    documents(spark, SEEDS).drop("doc_key").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id string, title string, body string, url string").parquet(source)
    for n, model in enumerate((Failing(), LetterModel())):  # the second run replays the batch
        ingest_stream(store, stream, "s", str(tmp_path / f"cp{n}"), model, once=True).awaitTermination()
    assert store.snapshot().documents.count() == store.snapshot().vectors().count() == len(SEEDS)


def test_small_commits_spread_over_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "spread"), buckets=8)
    for n in range(12):
        store.add_documents(documents(spark, [(f"{n}", "tea", "time")]).coalesce(1))
    rows = store.table("postings").select("commit_seq", "row_id").distinct()
    assert rows.select(F.pmod(F.hash("row_id"), F.lit(8))).distinct().count() >= 5
    assert rows.select("row_id").distinct().count() == 12


@pytest.mark.parametrize("limit", [store_module.BROADCAST_DELETED, 0])
def test_deletes_shuffle_no_text_while_few(spark, store, monkeypatch, limit):
    monkeypatch.setattr(store_module, "BROADCAST_DELETED", limit)
    monkeypatch.setattr(store_module, "LITERAL_ROWS", 0)
    store.add_documents(documents(spark, SEEDS[:3]))
    store.add_documents(documents(spark, SEEDS[2:]))
    first = store.snapshot().seq
    assert store.delete_documents(ids_frame(spark, SEEDS[2][0], "unknown")) == 2
    assert store.delete_documents(ids_frame(spark, SEEDS[4][0])) == 1
    live = store.snapshot()
    assert sorted(r.id for r in live.documents.collect()) == sorted(s[0] for s in (*SEEDS[:2], SEEDS[3]))
    assert store.snapshot(first).documents.count() == 6 and live.hidden == 3
    plan = live.stored()._jdf.queryExecution().executedPlan().toString()
    if limit:
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def scanned_rows(frame):
    plan = frame._jdf.queryExecution().executedPlan()
    plan.execute().count()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("count", [5, 13, 50, 400])
def test_literals_skip_data(spark, tmp_path, count):
    path = str(tmp_path / "terms")
    rows = spark.range(0, 200_000, numPartitions=1).select(F.format_string("%08d", "id").alias("term"), "id")
    rows.write.option("parquet.page.row.count.limit", 500).parquet(path)
    terms = [f"{n:08d}" for n in range(0, 200_000, 200_000 // count)][:count]
    found = spark.read.parquet(path).where(one_of("term", ["", *terms]))
    assert found.count() == count
    assert scanned_rows(found) <= 500 * (count + 1)


def test_streams(spark, store, tmp_path):
    source = str(tmp_path / "in")
    documents(spark, SEEDS).drop("doc_key").repartition(3).write.parquet(source)
    schema = "id string, title string, body string, url string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(store, stream, "s", str(tmp_path / "cp1"), once=True).awaitTermination()

    run()
    queries = ("rust safety", "search")
    expected = found(scan_corpus(documents(spark, SEEDS)), spark, *queries)
    assert sorted(found(store.snapshot(), spark, *queries)) == sorted(expected)
    # A batch that is replayed is recognised by its number.
    commits = store.log().where("done").count()
    assert store.stream_commit("s", 0) is not None and store.stream_commit("s", 999) is None
    run()
    assert store.log().where("done").count() == commits

    asked = str(tmp_path / "asked")
    spark.createDataFrame(list(enumerate(queries)), "qid long, q string").write.parquet(asked)
    stream = spark.readStream.schema("qid long, q string").parquet(asked)
    out = str(tmp_path / "out")
    search_stream(store, stream, out, str(tmp_path / "cp2"), once=True).awaitTermination()
    rows = [(r.qid, r.id, r.score) for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == sorted(expected)


def test_json_documents(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text(
        '[{"id": "1", "title": "t", "body": "b", "metadata": {"b": 1, "a": [2]}, "extra": 5},'
        ' {"id": "", "title": "u", "body": "c", "url": ""}]'
    )
    docs = read_documents(spark, str(path))
    back = from_storage(to_storage(docs)).orderBy("title")
    rows = back.select("id", "url", F.to_json("metadata").alias("m")).collect()
    assert [(r.id, r.url, r.m) for r in rows] == [("1", None, '{"a":[2],"b":1}'), ("", None, None)]


def test_json_rejects(spark, tmp_path):
    lines = ['{"id":"1","title":"t","body":"b"}', '{"id":"2","title":"t"', "", '{"id":"3","title":7,"body":"b"}',
             '{"title":"t","body":"b","id":null,"url":null,"metadata":null}', '{"id":"4","title":"t"}', '"text"', '{"id":5,"title":"t","body":"b"}']
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(lines))
    good, bad = read_documents_apart(spark, str(path), lines=True)
    assert sorted(str(r.id) for r in good.collect()) == ["1", "None"]
    reasons = {r.raw: r.reason for r in bad.collect()}
    assert reasons == {lines[1]: "not JSON", lines[3]: "title is not a string", lines[5]: "body is not a string",
                       lines[6]: "not an object", lines[7]: "id is not a string"}
    with pytest.raises(Exception, match="not JSON|not a string|not an object"):
        read_documents(spark, str(path), lines=True).select("url").collect()
    whole = tmp_path / "docs.json"
    whole.write_text(f"[{lines[0]}, {lines[3]}]")
    good, bad = read_documents_apart(spark, str(whole))
    assert good.first().id == "1" and bad.count() == 1
    whole.write_text(f"[{lines[0]}, ")
    assert [r.reason for r in read_documents_apart(spark, str(whole))[1].collect()] == ["not JSON"]


def test_deletes_and_vectors_write_one_file_for_each_bucket(spark, store):
    """However many tasks write; a file for each task and bucket would grow with the product."""
    rows = [(str(i), "t", f"b{i}") for i in range(60)]
    vectors = spark.createDataFrame([(str(i), [1.0] * 8) for i in range(60)], "id string, embedding array<float>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.add_documents(documents(spark, rows).repartition(6))
        store.put_vectors(vectors.repartition(6))
        store.delete_documents(spark.createDataFrame([(str(i),) for i in range(40)], "id string").repartition(6))
        store.delete_vectors(spark.createDataFrame([(str(i),) for i in range(40, 50)], "id string").repartition(6))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, commits in (("deleted", 1), ("vectors", 3)):
        files = store.table(name).select("commit_seq", F.input_file_name().alias("f")).distinct().groupBy("commit_seq").count()
        counts = [r["count"] for r in files.collect()]
        assert len(counts) == commits and max(counts) <= store.buckets == 3
    assert sorted(int(r.id) for r in store.snapshot().documents.collect()) == list(range(40, 60))
    assert sorted(int(r.id) for r in store.snapshot().vectors().collect()) == list(range(50, 60))


@pytest.mark.parametrize("literal,broadcast", [(1_000, 1_000_000), (1, 1_000_000), (1, 0)])
def test_get_reads_documents_only(spark, store, monkeypatch, literal, broadcast):
    monkeypatch.setattr(store_module, "LITERAL_TERMS", literal)
    monkeypatch.setattr(store_module, "BROADCAST_DELETED", broadcast)
    store.add_documents(documents(spark, [("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z"), ("c", "4", "w")]))
    store.delete_documents(spark.createDataFrame([("c",)], "id string"))
    wanted = [("default", i) for i in ("a", "a", "c", "nobody", None)] + [("other", "b")]
    found = store.snapshot().get(spark.createDataFrame(wanted, "index_name string, id string"))
    assert found.columns[:3] == ["index_name", "commit_seq", "row_id"]
    assert sorted((r.id, r.title) for r in found.collect()) == [("a", "1"), ("a", "2")]
    assert not any("_postings" in f or "/postings/" in f for f in found.inputFiles())


def test_buckets_follow_the_text(spark, monkeypatch):
    docs = documents(spark, [(str(i), "title", "body " * 20) for i in range(100)])
    assert session_module.bucket_count(docs) == 8
    monkeypatch.setattr(session_module, "BUCKET_TEXT", 500)
    assert session_module.bucket_count(docs) == 21
