"""Ready-made queries over the given tables, one per operator of the package.

Every entry takes a session and a table folder and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.text import candidate_text
from termloom.functions.vector import cosine
from termloom.operators.clauses import (
    DOC_MARKER,
    clause_requests,
    compile_requests,
    match_all,
    phrase,
    term,
    term_range,
    term_set,
    with_defaults,
)
from termloom.operators.embed import embed_texts
from termloom.operators.knn import knn
from termloom.operators.match import (
    BROADCAST_ROWS,
    fits_broadcast,
    keyword_pool,
    phrase_matches,
    score_documents,
)
from termloom.operators.postings import (
    build_postings,
    field_statistics,
    scan_corpus,
    term_statistics,
    token_rows,
)
from termloom.operators.querylog import latency_report
from termloom.operators.rerank import minmax, semantic_scores
from termloom.operators.topk import top_k
from termloom.operators.vectors import (
    delete_vectors,
    deleted_found,
    keep_dims,
    latest_vectors,
    rejected_dims,
    vector_count,
)
from termloom.plans.response import response
from termloom.plans.search import search
from termloom.session import bucket_count, work_folder
from termloom.sources import tables
from termloom.sources.documents import (
    fill_ids,
    from_storage,
    read_documents,
    read_documents_apart,
    to_storage,
)
from termloom.sources.memo import EmbeddingMemo
from termloom.sources.store import Store
from termloom.sources.vector_files import read_vector_object
from termloom.streaming.ingest import ingest_stream
from termloom.streaming.latency import latency_windows, report_stream
from termloom.streaming.search import search_stream
from termloom.streaming.vectors import current_vectors, last_changes, publish_stream

KEY = ("doc_key",)
DIMS = 64

# Fixed letters whose counts make up the vector of the demonstration model.
LETTERS = "etaoinsr"


class LetterModel:
    """A deterministic model: how often each of eight letters occurs."""

    name = "letters"
    dims = len(LETTERS)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(text.count(letter)) for letter in LETTERS] for text in texts]


class FussyModel(LetterModel):
    """The letter model, failing on texts whose length is divisible by ``step``."""

    def __init__(self, step: int):
        self.step = step

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if any(len(text) % self.step == 0 for text in texts):
            raise ValueError("no vector for this text")
        return super().embed(texts)


class LengthScorer(LetterModel):
    """A model that scores (query, text) pairs itself: -1..1 by the text's length."""

    name = "length"

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        return [(len(text) % 100) / 50.0 - 1.0 for text in texts]


def _docs(spark, folder):
    return tables.corpus_documents(spark, folder)


def _corpus(spark, folder):
    return scan_corpus(_docs(spark, folder))


def _language_corpus(spark, folder):
    return scan_corpus(tables.corpus_documents(spark, folder, per_language=True))


def _scored(spark, folder, clauses: dict[int, list[dict]], corpus=_corpus) -> DataFrame:
    requests = clause_requests(spark, [dict(qid=q, clauses=c) for q, c in clauses.items()])
    return score_documents(corpus(spark, folder), compile_requests(requests)).select(
        "qid", "doc_key", "score"
    )


# -- text and statistics ------------------------------------------------------


def tokenize(spark, folder):
    rows = token_rows(_docs(spark, folder), KEY).where(F.col("term") != DOC_MARKER)
    return rows.select("doc_key", "field", "pos", "term")


def postings(spark, folder):
    rows = build_postings(_docs(spark, folder), KEY).where(F.col("term") != DOC_MARKER)
    return rows.select(
        "doc_key",
        "field",
        "term",
        "tf",
        F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"),
    )


def corpus_stats(spark, folder):
    docs = tables.corpus_documents(spark, folder, per_language=True)
    stats = term_statistics(build_postings(docs, KEY, positions=False))
    return field_statistics(stats).withColumn("avgdl", F.round("avgdl", 6))


def doc_freq(spark, folder):
    corpus = _corpus(spark, folder)
    compiled = compile_requests(tables.benchmark_requests(spark, folder))
    postings = corpus.postings_for(compiled, broadcast=fits_broadcast(compiled))
    stats = corpus.statistics_for(compiled, postings)
    return stats.where(F.col("term") != DOC_MARKER).select("field", "term", "df")


# -- predicates ---------------------------------------------------------------


def match_any(spark, folder):
    compiled = compile_requests(tables.benchmark_requests(spark, folder))
    return score_documents(_corpus(spark, folder), compiled).select("qid", "doc_key")


def match_all_terms(spark, folder):
    must = partial(term, occur="must")
    return _scored(
        spark,
        folder,
        {
            1: [must("the"), must("of"), term("trash")],
            2: [must("la"), must("de"), must("des")],
            3: [must("the", field="title"), must("idiot", field="body")],
        },
    )


def must_not(spark, folder):
    return _scored(
        spark,
        folder,
        {
            1: [term("in"), term("the", occur="must_not")],
            2: [term("de", occur="must"), term("la"), term("the", occur="must_not", field="body")],
        },
    )


def phrase_query(spark, folder):
    corpus = _corpus(spark, folder)
    words = {1: "of the", 2: "and Attion to", 3: "the the", 4: "de la", 5: "in-the"}
    requests = clause_requests(
        spark, [dict(qid=q, clauses=[phrase(text)]) for q, text in words.items()]
    )
    return _phrase_hits(corpus, compile_requests(requests))


def phrase_slop(spark, folder):
    corpus = _corpus(spark, folder)
    wanted = {
        1: phrase("of the", slop=1),
        2: phrase("in to", slop=2, field="body"),
        3: phrase("la de", slop=3),
        4: phrase("the and attion", slop=2, field="body"),
    }
    requests = clause_requests(spark, [dict(qid=q, clauses=[c]) for q, c in wanted.items()])
    return _phrase_hits(corpus, compile_requests(requests))


def _phrase_hits(corpus, compiled) -> DataFrame:
    found = phrase_matches(compiled.phrases, corpus.postings_for(compiled), KEY, small=True)
    return found.select("qid", "doc_key", "field", "tf")


def field_term(spark, folder):
    return _scored(
        spark,
        folder,
        {
            1: [term("the", field="title")],
            2: [term("trash", field="body")],
            3: [term("5", field="id")],
            4: [term("7", field="id"), term("idiot", field="body")],
        },
    )


def stored_only(spark, folder):
    """Words that only url and metadata hold find nothing and leave other scores as they are."""

    def marked(spark, folder):
        docs = _docs(spark, folder).withColumns(
            {
                "url": F.concat(F.lit("https://urlmark.example/"), "id"),
                "metadata": F.parse_json(F.lit('{"tag": "metamark"}')),
            }
        )
        return scan_corpus(docs)

    return _scored(
        spark,
        folder,
        {
            1: [term("trash"), term("urlmark"), term("metamark")],
            2: [term("urlmark"), term("metamark")],
            3: [term("urlmark", occur="must"), term("trash")],
            4: [term("trash"), term("metamark", occur="must_not")],
        },
        marked,
    )


def boosted(spark, folder):
    return _scored(
        spark, folder, {1: [term("trash", boost=3.0), term("idiot", field="body", boost=0.5)]}
    )


def range_query(spark, folder):
    return _scored(
        spark,
        folder,
        {
            1: [term_range("body", "tra", "trb")],
            2: [term_range(None, "zz", None, incl_lower=False)],
            3: [term_range("id", "10", "12", incl_upper=False)],
            4: [term_range("body", None, "1", incl_upper=True), term("the")],
        },
    )


def many_ranges(spark, folder):
    """Documents that meet most ranges of terms, for thousands of ranges in one batch."""
    found = search(_corpus(spark, folder), tables.benchmark_range_requests(spark, folder))
    return found.select("qid", "rank", "id", "score")


def set_query(spark, folder):
    return _scored(
        spark,
        folder,
        {
            1: [term_set(["trash", "idiot", "nosuchword"])],
            2: [term_set(["1", "2", "3"], field="id", boost=2.0)],
            3: [term("the", occur="must"), term_set(["under", "ja"], field="body", occur="must")],
        },
    )


def all_query(spark, folder):
    requests = clause_requests(
        spark,
        [
            dict(qid=1, clauses=[match_all()], index_name="en"),
            dict(qid=2, clauses=[match_all(), term("de", occur="must_not")], index_name="fr"),
        ],
    )
    corpus = _language_corpus(spark, folder)
    found = score_documents(corpus, compile_requests(requests))
    return found.join(requests.select("qid", "index_name"), "qid").select(
        "qid", "index_name", "doc_key", "score"
    )


# -- ranking ------------------------------------------------------------------


def bm25_topk(spark, folder):
    return search(_corpus(spark, folder), tables.benchmark_requests(spark, folder)).select(
        "qid", "rank", "id", "score"
    )


def phrase_bm25(spark, folder):
    return _scored(
        spark, folder, {1: [phrase("of the")], 2: [phrase("and attion to", boost=2.0)]}
    )


def overfetch_pool(spark, folder):
    compiled = compile_requests(tables.benchmark_requests(spark, folder))
    return keyword_pool(_corpus(spark, folder), compiled).select(
        "qid", "bm25_rank", "doc_key", "bm25"
    )


def pruned_pool(spark, folder):
    """Pools of short requests with frequent words, hopeless documents left unscored."""
    compiled = compile_requests(tables.short_requests(spark, folder))
    return keyword_pool(_corpus(spark, folder), compiled, prune=True).select(
        "qid", "doc_key", "bm25", "bm25_rank"
    )


def request_defaults(spark, folder):
    item = F.col("qid")
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {
            "limit": F.when(item % 3 != 0, (item % 7 + 1).cast("int")),
            "ai": F.when(item % 4 != 0, item % 4 == 1),
            "ai_weight": F.when(item % 5 != 0, (item % 5) * 0.5 - 0.6),
        }
    )
    return with_defaults(requests).select("qid", "q", "index_name", "limit", "ai", "ai_weight")


def response_envelope(spark, folder):
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {
            "q": F.when(F.col("qid") % 10 == 9, F.lit("nosuchword")).otherwise(F.col("q")),
            "limit": (F.col("qid") % 5 + 1).cast("int"),
            "ai": F.col("qid") % 2 == 0,
        }
    )
    hits = search(_corpus(spark, folder), requests)
    answers = response(requests, hits, ai_available=True)
    shown = F.transform("hits", lambda h: F.concat_ws("|", h["id"], h["title"], h["metadata"]))
    return answers.select(
        "qid",
        "query",
        "ai_enabled",
        F.size("hits").alias("n_hits"),
        F.array_join(shown, "; ").alias("hits"),
    )


def scoped_search(spark, folder):
    """Each request in the index of its own language, and one in an unknown index."""
    names = F.array(*[F.lit(n) for n in ("en", "fr", "de", "es", "xx")])
    requests = tables.benchmark_requests(spark, folder).withColumn(
        "index_name", F.get(names, (F.col("qid") % 5).cast("int"))
    )
    return search(_language_corpus(spark, folder), requests).select(
        "qid", "index_name", "rank", "id", "score"
    )


def user_turn_search(spark, folder):
    requests = tables.user_turn_requests(spark, folder).withColumn("limit", F.lit(3))
    return search(_corpus(spark, folder), requests).select("qid", "rank", "id", "score")


def web_search(spark, folder):
    corpus = scan_corpus(tables.web_documents(spark, folder))
    requests = tables.benchmark_requests(spark, folder).withColumn("index_name", F.lit("web"))
    return search(corpus, requests).select("qid", "rank", "id", "url", "score")


# -- vectors ------------------------------------------------------------------


def cosine_pairs(spark, folder):
    left = tables.vector_table(spark, folder).select(F.col("id").cast("long").alias("a"), "embedding")
    # Every tenth vector is emptied, so that the zero rule is exercised.
    zero = F.transform("embedding", lambda x: x * F.lit(0.0).cast("float"))
    left = left.withColumn("embedding", F.when(F.col("a") % 10 == 0, zero).otherwise(F.col("embedding")))
    right = left.select((F.col("a") - 1).alias("a"), F.col("embedding").alias("next"))
    return left.join(right, "a").select(
        "a", F.round(cosine("embedding", "next"), 6).alias("cosine")
    )


def _history(spark, folder) -> DataFrame:
    """Every vector once, then some again: negated (label 1), cut short (id % 7 = 0)."""
    base = tables.vector_table(spark, folder)
    number = F.col("id").cast("long")
    negated = F.transform("embedding", lambda x: -x)
    return (
        base.withColumn("n", F.lit(1))
        .unionByName(base.where("label = 1").withColumns({"embedding": negated, "n": F.lit(2)}))
        .unionByName(
            base.where(number % 7 == 0).withColumns(
                {"embedding": F.slice("embedding", 1, 32), "n": F.lit(3)}
            )
        )
    )


def vector_upsert_latest(spark, folder):
    live = latest_vectors(keep_dims(_history(spark, folder), DIMS), ["n"])
    return live.select("id", F.posexplode("embedding").alias("pos", "x")).select(
        "id", "pos", F.col("x").cast("double").alias("value")
    )


def vector_dims_reject(spark, folder):
    return rejected_dims(_history(spark, folder), DIMS).select("id", "n", "actual_dims")


def _toxic_ids(spark, folder) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1")
    return labels.select(F.lit("default").alias("index_name"), F.col("doc_id").cast("string").alias("id"))


def vector_delete(spark, folder):
    return deleted_found(tables.vector_table(spark, folder), _toxic_ids(spark, folder)).select(
        "id", "deleted"
    )


def vectors_left(spark, folder):
    return vector_count(
        delete_vectors(tables.vector_table(spark, folder), _toxic_ids(spark, folder))
    )


def _query_vectors(spark, folder) -> DataFrame:
    vectors = tables.vector_table(spark, folder)
    return vectors.select(
        F.col("id").cast("long").alias("qid"), F.col("embedding").alias("query_embedding")
    )


def knn_topk(spark, folder):
    return knn(tables.vector_table(spark, folder), _query_vectors(spark, folder), 10, DIMS)


def knn_of_all(spark, folder):
    """The three nearest vectors of every vector, queries met in groups around pivots."""
    vectors = tables.vector_table(spark, folder)
    queries = vectors.select(F.col("id").cast("long").alias("qid"), F.col("embedding").alias("query_embedding"))
    return knn(vectors, queries, 3, DIMS, grouped=True)


def knn_by_index(spark, folder):
    """Equal ids in several indexes: the index is part of the result and of the tie order."""
    vectors = tables.vector_table(spark, folder).withColumns(
        {"index_name": F.concat(F.lit("part"), F.col("label") % 3), "id": (F.col("id").cast("long") % 100).cast("string")}
    )
    return knn(vectors, _query_vectors(spark, folder), 10, DIMS, by_index=True)


def vector_object_import(spark, folder):
    """Vectors written as JSON objects of 250 entries, one per file, and read back."""
    target = _scratch(spark) + "/vectors"
    rows = tables.vector_table(spark, folder)
    entry = F.concat(F.to_json(F.array("id")), F.lit(":"), F.to_json("embedding"))
    entry = F.regexp_replace(entry, r'^\[("[^"]*")\]:', "$1:")
    objects = rows.groupBy(F.floor(F.col("id").cast("long") / 250).alias("part")).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value")
    )
    objects.write.partitionBy("part").option("lineSep", " ").text(target)
    read = read_vector_object(spark, target)
    return read.select("id", F.size("embedding").alias("dims"), _rounded_sum("embedding"))


def _rounded_sum(vector: str):
    total = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return F.round(total, 4).alias("total")


# -- embedding and reranking --------------------------------------------------


def candidate_texts(spark, folder):
    return _docs(spark, folder).select("id", candidate_text().alias("text"))


def embed_documents(spark, folder):
    texts = _docs(spark, folder).select("id", candidate_text().alias("text"))
    made = embed_texts(texts, LetterModel())
    return made.select("id", F.posexplode("embedding").alias("pos", "x")).select(
        "id", "pos", F.col("x").cast("double").alias("value")
    )


def embed_once(spark, folder):
    """Vectors of documents, test items and turns by one memo, and how many texts it then holds."""
    memo = EmbeddingMemo(LetterModel(), _scratch(spark))
    turn = F.concat_ws("-", "conv_id", "turn")
    parts = []
    for name, key in (("documents", F.col("doc_id")), ("benchmark", F.col("item_id")), ("conversations", turn)):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        texts = rows.select(F.lit(name).alias("source"), key.cast("string").alias("id"), "text")
        made = embed_texts(texts, memo).select("source", "id", F.posexplode("embedding").alias("pos", "x"))
        parts.append(made.select("source", "id", "pos", F.col("x").cast("double").alias("value")))
    held = memo.table(spark).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts.append(held.select(F.lit("memo").alias("source"), F.lit("texts").alias("id"), F.lit(0).alias("pos"), "value"))
    return reduce(DataFrame.unionByName, parts)


def minmax_bm25(spark, folder):
    compiled = compile_requests(tables.benchmark_requests(spark, folder))
    pool = keyword_pool(_corpus(spark, folder), compiled)
    return pool.select("qid", "doc_key", F.round(minmax("bm25"), 6).alias("bm25_norm"))


def _pool_with_ids(spark, folder) -> DataFrame:
    corpus = _corpus(spark, folder)
    compiled = compile_requests(tables.benchmark_requests(spark, folder))
    return corpus.fetch_ids(keyword_pool(corpus, compiled))


def semantic_rerank(spark, folder):
    pool = _pool_with_ids(spark, folder)
    scored = semantic_scores(
        pool,
        tables.vector_table(spark, folder),
        _query_vectors(spark, folder),
        few=pool.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS,
    )
    known = scored.where("ai_score is not null").withColumn("ai_score", F.round("ai_score", 6))
    order = [F.desc("ai_score"), F.asc("bm25_rank")]
    return top_k(known, ["qid"], order, 40).select("qid", "rank", "id", "ai_score")


def hybrid_search(spark, folder):
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {"ai": F.lit(True), "ai_weight": (F.col("qid") % 6) * 0.25}
    )
    return search(
        _corpus(spark, folder),
        requests,
        tables.vector_table(spark, folder),
        _query_vectors(spark, folder),
    ).select("qid", "rank", "id", "score")


def rerank_fallback(spark, folder):
    """Half the requests do not ask for reranking; a third have no query vector."""
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {"ai": F.col("qid") % 2 == 0, "limit": F.lit(10)}
    )
    missing = F.when(F.col("qid") % 3 != 0, F.col("query_embedding"))
    return search(
        _corpus(spark, folder),
        requests,
        tables.vector_table(spark, folder),
        _query_vectors(spark, folder).withColumn("query_embedding", missing),
    ).select("qid", "rank", "id", "score")


def rerank_on_the_fly(spark, folder):
    """Queries and candidates embedded by a model during the search."""
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {"ai": F.lit(True), "ai_weight": F.lit(0.5)}
    )
    return search(
        _corpus(spark, folder), requests, embedder=LetterModel(), embed_candidates=True
    ).select("qid", "rank", "id", "score")


def rerank_candidate_failure(spark, folder):
    """A model that fails on some texts: their queries keep the keyword order."""
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {"ai": F.lit(True), "ai_weight": F.lit(0.5)}
    )
    return search(
        _corpus(spark, folder), requests, embedder=FussyModel(50), embed_candidates=True
    ).select("qid", "rank", "id", "score")


def empty_pools(spark, folder):
    """A third of the requests is empty and a third matches nothing; the rest is reranked."""
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {
            "q": F.when(F.col("qid") % 3 == 0, "").when(F.col("qid") % 3 == 1, "zzzzqqqq").otherwise(F.col("q")),
            "ai": F.lit(True),
        }
    )
    vectors = tables.vector_table(spark, folder)
    found = search(_corpus(spark, folder), requests, vectors, _query_vectors(spark, folder))
    return found.select("qid", "rank", "id", "score")


def rerank_by_model(spark, folder):
    """A model that scores pairs itself replaces the cosine."""
    requests = tables.benchmark_requests(spark, folder).withColumns(
        {"ai": F.lit(True), "ai_weight": F.lit(0.3)}
    )
    return search(_corpus(spark, folder), requests, embedder=LengthScorer()).select(
        "qid", "rank", "id", "score"
    )


# -- documents and store ------------------------------------------------------


def _scratch(spark) -> str:
    """A new folder of this run's own inside the shared work folder."""
    from uuid import uuid4

    return f"{work_folder(spark)}/run-{uuid4().hex}"


_stores: dict[tuple[str, str], Store] = {}


def _scenario(spark: SparkSession, folder: str) -> Store:
    """A store with six commits, built once per session and folder.

    1 all documents, one index per language; 2 the toxic ones once more;
    3 those of quality 0 deleted; 4 the toxic ones of quality 0 added again;
    5 all vectors; 6 the vectors of toxic documents deleted.
    """
    made = (spark.sparkContext.applicationId, folder)
    if made not in _stores:
        docs = tables.corpus_documents(spark, folder, per_language=True)
        labels = spark.read.parquet(f"{folder}/labels.parquet")

        def chosen(condition: str) -> DataFrame:
            ids = labels.where(condition).select(F.col("doc_id").alias("doc_key"))
            return docs.join(ids, "doc_key", "left_semi")

        store = Store(spark, _scratch(spark), buckets=bucket_count(docs), dims=DIMS)
        store.add_documents(docs)
        store.add_documents(chosen("toxic = 1"))
        store.delete_documents(chosen("quality = 0"))
        store.add_documents(chosen("toxic = 1 and quality = 0"))
        store.put_vectors(tables.vector_table(spark, folder))
        store.delete_vectors(_toxic_ids(spark, folder))
        _stores[made] = store
    return _stores[made]


def id_fill(spark, folder):
    """Every third id is blanked and filled with a random one."""
    blank = F.when(F.col("doc_key") % 3 == 0, F.lit("")).otherwise(F.col("id"))
    filled = fill_ids(_docs(spark, folder).withColumn("id", blank))
    return filled.select(
        "doc_key",
        F.when(F.length("id") == 36, F.lit("made")).otherwise(F.col("id")).alias("id"),
    )


def json_documents(spark, folder):
    """Documents written as JSON lines with an extra key, then read back."""
    path = _scratch(spark) + "/json"
    docs = _docs(spark, folder).drop("index_name").withColumn("extra", F.lit(1))
    docs.write.json(path)
    read = read_documents(spark, path, lines=True)
    return read.select(
        "id", "title", "body", "url", F.to_json("metadata").alias("metadata")
    )


def json_rejects(spark, folder):
    """Lines and arrays with malformed documents among them: what is read, what is set apart."""
    path = _scratch(spark)
    docs = _docs(spark, folder).select("doc_key", "id", "title", "body")
    good = F.to_json(F.struct("body", "id", "title"))
    number = F.concat(F.lit('{"body":"b","id":"'), "id", F.lit('","title":'), "id", F.lit("}"))
    broken = F.concat(F.lit('{"id":"'), "id", F.lit('","title":'))
    kind = F.col("doc_key") % 5
    lines = docs.select(F.when(kind == 0, broken).when(kind == 1, number).otherwise(good).alias("value"))
    lines.write.text(f"{path}/lines")
    arrays = docs.groupBy(F.floor(F.col("doc_key") / 100)).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(F.when(kind == 1, number).otherwise(good)), ","), F.lit("]")).alias("value")
    )
    arrays.select("value").write.option("lineSep", " ").option("maxRecordsPerFile", 1).text(f"{path}/arrays")
    parts = []
    for form in ("lines", "arrays"):
        taken, rest = read_documents_apart(spark, f"{path}/{form}", lines=form == "lines")
        parts.append(taken.select(F.lit(form).alias("form"), "id", "title", F.lit(None).cast("string").alias("raw")))
        parts.append(rest.select(F.lit(form).alias("form"), F.lit(None).cast("string"), "reason", "raw"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def storage_form(spark, folder):
    docs = _pages_with_gaps(spark, folder)
    return to_storage(docs).select("id", "title", "url", "metadata")


def stored_fields(spark, folder):
    stored = to_storage(_pages_with_gaps(spark, folder))
    return from_storage(stored).select(
        "id", "title", "url", F.to_json("metadata").alias("metadata")
    )


def _pages_with_gaps(spark, folder) -> DataFrame:
    """Pages with some urls empty or absent, and some metadata broken or absent."""
    key = F.col("doc_key")
    meta = (
        F.when(key % 4 == 0, F.lit('{"page":1}'))
        .when(key % 4 == 1, F.lit("{broken"))
        .when(key % 4 == 2, F.lit(""))
    )
    url = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.col("url"))
    return tables.web_documents(spark, folder).withColumns({"metadata": meta, "url": url})


def _live_rows(store: Store, seq: int) -> DataFrame:
    return store.snapshot(seq).documents.groupBy("index_name", "id").agg(
        F.count(F.lit(1)).alias("copies")
    )


def add_append(spark, folder):
    return _live_rows(_scenario(spark, folder), 2)


def delete_by_id(spark, folder):
    return _live_rows(_scenario(spark, folder), 3)


def snapshot_read(spark, folder):
    store = _scenario(spark, folder)
    views = [
        store.snapshot(seq)
        .documents.groupBy("index_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("as_of", F.lit(seq))
        for seq in (1, 2, 3, 4)
    ]
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view)
    return out


def get_by_id(spark, folder):
    store = _scenario(spark, folder)
    wanted = _toxic_ids(spark, folder).select("id").withColumn("index_name", F.lit("en"))
    return store.snapshot(4).get(wanted).select("index_name", "commit_seq", "id", "title", "body")


def list_indexes(spark, folder):
    return _scenario(spark, folder).list_indexes()


def store_search(spark, folder):
    """Keyword search on the stored postings, after appends and deletes."""
    store = _scenario(spark, folder)
    requests = tables.benchmark_requests(spark, folder).withColumn("index_name", F.lit("en"))
    return _tie_safe(search(store.snapshot(4), requests))


def _tie_safe(hits: DataFrame) -> DataFrame:
    """Hits whose id is shown only where its score is not tied.

    Tied rows of a store come in insertion order, which depends on how the
    input was split.
    """
    same, query = Window.partitionBy("qid", "score"), Window.partitionBy("qid")
    alone = (F.count("id").over(same) == 1) & (F.col("score") > F.min("score").over(query))
    return hits.select("qid", "rank", F.when(alone, F.col("id")).alias("id"), "score")


def store_vectors(spark, folder):
    live = _scenario(spark, folder).snapshot().vectors()
    return live.select("id", F.size("embedding").alias("dims"), _rounded_sum("embedding"))


def vectors_refilled(spark, folder):
    """Documents added with a model that fails on some; a second model fills the gaps."""
    docs = _docs(spark, folder)
    store = Store(spark, _scratch(spark), buckets=bucket_count(docs))
    store.add_documents(docs, embedder=FussyModel(7))
    before = store.snapshot().vectors().select("index_name", "id", F.lit(True).alias("at_once"))
    store.fill_vectors(LetterModel())
    live = store.snapshot().vectors().join(before, ["index_name", "id"], "left")
    return live.select("id", F.coalesce("at_once", F.lit(False)).alias("at_once"), _rounded_sum("embedding"))


# -- streams and logs ---------------------------------------------------------

_STREAM_DOC = "doc_key long, index_name string, id string, title string, body string"


def _document_stream(spark, folder, work: str) -> DataFrame:
    source = f"{work}/incoming"
    columns = ["doc_key", "index_name", "id", "title", "body"]
    _docs(spark, folder).select(*columns).repartition(3, "doc_key").write.parquet(source)
    return spark.readStream.schema(_STREAM_DOC).option("maxFilesPerTrigger", 1).parquet(source)


def stream_ingest(spark, folder):
    """Documents arrive in three micro-batches; the store must hold each once."""
    work = _scratch(spark)
    store = Store(spark, f"{work}/store", buckets=bucket_count(_docs(spark, folder)))
    stream = _document_stream(spark, folder, work)
    ingest_stream(store, stream, "docs", f"{work}/checkpoint", once=True).awaitTermination()
    stats = store.snapshot().visible("term_stats").where(F.col("field") == "body")
    return (
        stats.where(F.col("term") != DOC_MARKER)
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
    )


def stream_search(spark, folder):
    """Requests arrive as a stream and run on the newest snapshot."""
    work = _scratch(spark)
    store = _scenario(spark, folder)
    requests = tables.benchmark_requests(spark, folder).withColumn("index_name", F.lit("en"))
    requests.repartition(2, "qid").write.parquet(f"{work}/requests")
    stream = (
        spark.readStream.schema("qid long, q string, index_name string")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{work}/requests")
    )
    search_stream(store, stream, f"{work}/hits", f"{work}/checkpoint", once=True).awaitTermination()
    return _tie_safe(spark.read.parquet(f"{work}/hits"))


def latency(spark, folder):
    log = spark.read.parquet(f"{folder}/events.parquet")
    report = latency_report(log, "value", "ts", ["event_type"], exact=True)
    return report.select(
        "event_type", "n", *[F.round(c, 6).alias(c) for c in ("qps", "p50", "p95", "p99")]
    )


def stream_latency(spark, folder):
    """The request log arrives in three parts, in the order of time; windows of an hour that are closed."""
    work = _scratch(spark)
    log = spark.read.parquet(f"{folder}/events.parquet").select("ts", "event_type", "value")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = log.agg(F.min(micros).alias("first"), F.max(micros).alias("last")).first()
    step = (ends["last"] - ends["first"]) // 3 + 1
    part = F.floor((micros - ends["first"]) / step)
    for number in range(3):
        log.where(part == number).write.mode("append").parquet(f"{work}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/log")
    # Files of one part are read in any order, so rows may be late by a part.
    windows = latency_windows(stream, "value", "ts", ["event_type"], late=f"{step // 1_000_000 + 1} seconds")
    report_stream(windows, f"{work}/report", f"{work}/checkpoint", once=True).awaitTermination()
    found = spark.read.schema(windows.schema).parquet(f"{work}/report")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("start", "end")})


def stream_vectors(spark, folder):
    """Upserts and deletes in three micro-batches, the first upserts late and then once more."""
    work = _scratch(spark)
    upserts = _history(spark, folder).withColumn("deleted", F.lit(False))
    deletes = _toxic_ids(spark, folder).withColumns({"n": F.lit(4), "deleted": F.lit(True)})
    newer, first = upserts.where("n > 1"), upserts.where("n = 1")
    for part in (newer, first.unionByName(deletes, allowMissingColumns=True), first):
        part.write.mode("append").parquet(f"{work}/changes")
        stream = spark.readStream.schema(spark.read.parquet(f"{work}/changes").schema).parquet(f"{work}/changes")
        last = last_changes(stream, ["n"], DIMS)
        publish_stream(last, f"{work}/vectors", f"{work}/checkpoint", once=True).awaitTermination()
    live = current_vectors(spark.read.parquet(f"{work}/vectors"))
    return live.select("id", F.posexplode("embedding").alias("pos", "x")).select(
        "id", "pos", F.col("x").cast("double").alias("value")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize": tokenize,
    "postings": postings,
    "corpus_stats": corpus_stats,
    "doc_freq": doc_freq,
    "match_any": match_any,
    "match_all_terms": match_all_terms,
    "must_not": must_not,
    "phrase": phrase_query,
    "phrase_slop": phrase_slop,
    "field_term": field_term,
    "stored_only": stored_only,
    "boosted": boosted,
    "term_range": range_query,
    "term_ranges_many": many_ranges,
    "term_set": set_query,
    "match_all": all_query,
    "bm25_topk": bm25_topk,
    "phrase_bm25": phrase_bm25,
    "overfetch_pool": overfetch_pool,
    "pruned_pool": pruned_pool,
    "request_defaults": request_defaults,
    "response_envelope": response_envelope,
    "scoped_search": scoped_search,
    "user_turn_search": user_turn_search,
    "web_search": web_search,
    "cosine_pairs": cosine_pairs,
    "vector_upsert_latest": vector_upsert_latest,
    "vector_dims_reject": vector_dims_reject,
    "vector_delete": vector_delete,
    "vectors_left": vectors_left,
    "knn_topk": knn_topk,
    "knn_by_index": knn_by_index,
    "knn_of_all": knn_of_all,
    "vector_object_import": vector_object_import,
    "candidate_texts": candidate_texts,
    "embed_documents": embed_documents,
    "embed_once": embed_once,
    "minmax_bm25": minmax_bm25,
    "semantic_rerank": semantic_rerank,
    "hybrid_search": hybrid_search,
    "rerank_fallback": rerank_fallback,
    "rerank_on_the_fly": rerank_on_the_fly,
    "rerank_candidate_failure": rerank_candidate_failure,
    "empty_pools": empty_pools,
    "rerank_by_model": rerank_by_model,
    "id_fill": id_fill,
    "json_documents": json_documents,
    "json_rejects": json_rejects,
    "storage_form": storage_form,
    "stored_fields": stored_fields,
    "add_append": add_append,
    "delete_by_id": delete_by_id,
    "snapshot_read": snapshot_read,
    "get_by_id": get_by_id,
    "list_indexes": list_indexes,
    "store_search": store_search,
    "store_vectors": store_vectors,
    "vectors_refilled": vectors_refilled,
    "stream_ingest": stream_ingest,
    "stream_search": stream_search,
    "latency_report": latency,
    "stream_latency": stream_latency,
    "stream_vectors": stream_vectors,
}
