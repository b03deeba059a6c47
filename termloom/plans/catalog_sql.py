"""SQL counterparts of the catalog's queries, for checking results.

They are written in the SQL of a single-process checker and share its common
table expressions; they are not used by the library.
"""

from __future__ import annotations

PATTERN = r"'[\p{L}\p{N}]+'"

DOCS = """docs AS (
  SELECT {index} AS index_name, doc_id AS doc_key, CAST(doc_id AS VARCHAR) AS id,
         split_part(text, '.', 1) AS title, text AS body
  FROM documents)"""

PAGES = r"""docs AS (
  SELECT 'web' AS index_name, page_id AS doc_key, CAST(page_id AS VARCHAR) AS id,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_replace(html, '<[^>]*>', ' ', 'g') AS body, url
  FROM pages)"""

ANALYSIS = f"""
fields AS (
  SELECT index_name, doc_key, 'title' AS field, title AS txt FROM docs
  UNION ALL SELECT index_name, doc_key, 'body', body FROM docs),
split AS (
  SELECT index_name, doc_key, field, regexp_extract_all(txt, {PATTERN}) AS t FROM fields),
tok AS (
  SELECT index_name, doc_key, field, pos, lower(tok) AS term FROM (
    SELECT index_name, doc_key, field, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM split)
  WHERE strlen(tok) < 40),
dl AS (
  SELECT index_name, doc_key, field, len(list_filter(t, lambda x: strlen(x) < 40)) AS dl FROM split),
stats AS (
  SELECT index_name, field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_tokens,
         sum(dl) / CAST(count(*) AS DOUBLE) AS avgdl
  FROM dl GROUP BY ALL),
post AS (
  SELECT index_name, doc_key, field, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT index_name, field, term, count(*) AS df FROM post GROUP BY ALL),
idf AS (
  SELECT index_name, field, term, df,
         ln(1e0 + (n_docs - df + 0.5e0) / (df + 0.5e0)) AS idf
  FROM df JOIN stats USING (index_name, field)),
weighed AS (
  SELECT index_name, doc_key, field, term, tf,
         idf * 2.2e0 * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS w
  FROM post JOIN idf USING (index_name, field, term)
  JOIN dl USING (index_name, doc_key, field) JOIN stats USING (index_name, field))"""

REQUESTS = f"""
request AS (
  SELECT item_id AS qid, list_transform(
           list_filter(regexp_extract_all(text, {PATTERN}), lambda x: strlen(x) < 40),
           lambda x: lower(x)) AS words
  FROM benchmark)"""

SHORT = REQUESTS.replace("AS words\n", "[1:3] || ['the', 'of'] AS words\n")

QTERMS = """
qterm AS (
  SELECT qid, {index} AS index_name, term, count(*) AS qtf
  FROM (SELECT qid, unnest(words) AS term FROM request) GROUP BY ALL)"""

SCORED = """
scored AS (
  SELECT qid, index_name, doc_key, round(sum(qtf * w), 6) AS bm25
  FROM qterm JOIN weighed USING (index_name, term) GROUP BY ALL),
pool AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_key) AS bm25_rank
    FROM scored) WHERE bm25_rank <= {pool})"""

COSINE = """CASE WHEN list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * x)) = 0
        OR list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * x)) = 0 THEN 0e0
   ELSE list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) END"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def corpus(index: str = "'default'", docs: str = DOCS) -> tuple[str, str]:
    return docs.format(index=index), ANALYSIS


def searched(pool: int, index: str = "'default'", docs: str = DOCS, scope: str | None = None,
             requests: str = REQUESTS) -> str:
    return _with(
        *corpus(index, docs),
        requests,
        QTERMS.format(index=scope or index),
        SCORED.format(pool=pool),
    )


BASE = _with(*corpus())
BY_LANGUAGE = _with(*corpus("lang"))


def word(qid: int, term: str, field: str | None = None, boost: float = 1.0) -> str:
    """Score rows of one scored term."""
    scope = f"AND field = '{field}'" if field else ""
    return (
        f"SELECT {qid} AS qid, doc_key, {boost}e0 * w AS s FROM weighed "
        f"WHERE term = '{term}' {scope}"
    )


def having(term: str, field: str | None = None) -> str:
    """Documents that contain a term."""
    scope = f"AND field = '{field}'" if field else ""
    return f"SELECT doc_key FROM post WHERE term = '{term}' {scope}"


def by_id(qid: int, value: str) -> str:
    """An exact id: one term of length one in every document."""
    return (
        f"SELECT {qid} AS qid, doc_key, "
        "(SELECT ln(1e0 + (count(*) - 1 + 0.5e0) / 1.5e0) FROM docs) AS s "
        f"FROM docs WHERE id = '{value}'"
    )


def total(*rows: str, keep: str = "TRUE") -> str:
    body = " UNION ALL ".join(rows)
    return (
        f"SELECT qid, doc_key, round(sum(s), 6) AS score FROM ({body}) r "
        f"WHERE {keep} GROUP BY qid, doc_key"
    )


def _phrase_rows(qid: int, words: list[str], slop: int, field: str | None) -> str:
    """Occurrences: distinct shifted positions of the last word within the slop."""
    names = [f"t{i}" for i in range(len(words))]
    joins = " JOIN ".join(
        f"tok {n}" + (f" ON {n}.doc_key = t0.doc_key AND {n}.field = t0.field" if i else "")
        for i, n in enumerate(names)
    )
    match = " AND ".join(f"{n}.term = '{w}'" for n, w in zip(names, words))
    moves = " + ".join(
        f"abs(({n}.pos - {i}) - ({m}.pos - {i - 1}))"
        for i, (m, n) in enumerate(zip(names, names[1:]), 1)
    )
    scope = f"AND t0.field = '{field}'" if field else ""
    return (
        f"SELECT {qid} AS qid, t0.doc_key AS doc_key, t0.field AS field, "
        f"CAST(count(DISTINCT {names[-1]}.pos) AS INTEGER) AS tf FROM {joins} "
        f"WHERE {match} {scope} AND {moves} <= {slop} GROUP BY ALL"
    )


def _phrase_scores(qid: int, words: list[str], boost: float) -> str:
    idf = " + ".join(
        f"(SELECT idf FROM idf WHERE idf.field = p.field AND idf.term = '{w}')" for w in words
    )
    return (
        f"SELECT {qid} AS qid, p.doc_key AS doc_key, {boost}e0 * ({idf}) * 2.2e0 * tf "
        "/ (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS s "
        f"FROM ({_phrase_rows(qid, words, 0, None)}) p "
        "JOIN dl ON dl.doc_key = p.doc_key AND dl.field = p.field "
        "JOIN stats ON stats.field = p.field"
    )


def _fused(ai: str, weight: str, limit: int, reranked: str = "TRUE", extra: str = "") -> str:
    return f""",
ranged AS (
  SELECT pool.*, ({weight}) AS weight, ({ai}) AS ai, ({reranked}) AS reranked,
         min(bm25) OVER (PARTITION BY qid) AS low, max(bm25) OVER (PARTITION BY qid) AS high
  FROM pool {extra}),
fused AS (
  SELECT qid, doc_key, bm25_rank, CASE WHEN reranked THEN
    round((1e0 - weight) * (bm25 - low) / greatest(high - low, 1.1920929e-7)
          + weight * (coalesce(ai, 0e0) + 1e0) / 2e0, 6) ELSE bm25 END AS score FROM ranged),
final AS (
  SELECT qid, CAST(doc_key AS VARCHAR) AS id, score,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, bm25_rank) AS INTEGER) AS rank
  FROM fused)
SELECT qid, rank, id, score FROM final WHERE rank <= {limit}"""


WITH_VECTORS = (
    "LEFT JOIN embeddings d ON d.vec_id = pool.doc_key LEFT JOIN embeddings q ON q.vec_id = pool.qid"
)
AI = (
    "CASE WHEN d.embedding IS NOT NULL AND q.embedding IS NOT NULL THEN "
    + COSINE.format(a="d.embedding", b="q.embedding")
    + " END"
)

# Fixed letters of the demonstration model.
LETTERS = "etaoinsr"


def letter_counts(text: str) -> str:
    counts = ", ".join(
        f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)" for c in LETTERS
    )
    return f"[{counts}]"


TOP = "SELECT qid, CAST(bm25_rank AS INTEGER) AS rank, CAST(doc_key AS VARCHAR) AS id, bm25 AS score FROM pool"

HISTORY = """history AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, 1 AS n, embedding FROM embeddings
  UNION ALL SELECT CAST(vec_id AS VARCHAR), 2, list_transform(embedding, lambda x: -x)
    FROM embeddings WHERE label = 1
  UNION ALL SELECT CAST(vec_id AS VARCHAR), 3, embedding[1:32] FROM embeddings WHERE vec_id % 7 = 0)"""

TURNS = f"""
request AS (
  SELECT conv_id * 1000 + turn AS qid, list_transform(
           list_filter(regexp_extract_all(text, {PATTERN}), lambda x: strlen(x) < 40),
           lambda x: lower(x)) AS words
  FROM conversations WHERE role = 'user')"""

GAPS = PAGES + """, gaps AS (
  SELECT id, doc_key, title,
         CASE WHEN doc_key % 3 = 1 THEN url WHEN doc_key % 3 = 0 THEN '' END AS url,
         CASE doc_key % 4 WHEN 0 THEN '{"page":1}' WHEN 1 THEN '{broken' WHEN 2 THEN '' END AS metadata
  FROM docs)"""

# Live rows of the store scenario at each commit.
COMMITS = """
base AS (SELECT d.*, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, 1) AS quality
         FROM (SELECT doc_id, lang, text FROM documents) d LEFT JOIN labels l USING (doc_id)),
c1 AS (SELECT *, 1 AS seq FROM base),
c2 AS (SELECT * FROM c1 UNION ALL SELECT *, 2 FROM base WHERE toxic = 1),
c3 AS (SELECT * FROM c2 WHERE quality <> 0),
c4 AS (SELECT * FROM c3 UNION ALL SELECT *, 4 FROM base WHERE toxic = 1 AND quality = 0)"""

STORE_DOCS = COMMITS + """, docs AS (
  SELECT lang AS index_name, seq * 100000000 + doc_id AS doc_key, CAST(doc_id AS VARCHAR) AS id,
         split_part(text, '.', 1) AS title, text AS body FROM c4)"""


def _copies(view: str) -> str:
    return (
        f"WITH {COMMITS} SELECT lang AS index_name, CAST(doc_id AS VARCHAR) AS id, "
        f"count(*) AS copies FROM {view} GROUP BY ALL"
    )


ORACLES: dict[str, str] = {
    "tokenize": BASE + "SELECT doc_key, field, CAST(pos AS INTEGER) AS pos, term FROM tok",
    "postings": BASE
    + "SELECT doc_key, field, term, CAST(count(*) AS INTEGER) AS tf, "
    "array_to_string(list_sort(list(pos)), ' ') AS positions FROM tok GROUP BY ALL",
    "corpus_stats": BY_LANGUAGE
    + "SELECT index_name, field, n_docs, n_tokens, round(avgdl, 6) AS avgdl FROM stats",
    "doc_freq": _with(*corpus(), REQUESTS, QTERMS.format(index="'default'"))
    + "SELECT field, term, df FROM df WHERE term IN (SELECT term FROM qterm)",
    "match_any": _with(*corpus(), REQUESTS, QTERMS.format(index="'default'"))
    + "SELECT DISTINCT qid, doc_key FROM qterm JOIN post USING (index_name, term)",
    "match_all_terms": BASE
    + " UNION ALL ".join(
        [
            total(word(1, "the"), word(1, "of"), word(1, "trash"),
                  keep=f"doc_key IN ({having('the')}) AND doc_key IN ({having('of')})"),
            total(word(2, "la"), word(2, "de"), word(2, "des"),
                  keep=f"doc_key IN ({having('la')}) AND doc_key IN ({having('de')}) "
                       f"AND doc_key IN ({having('des')})"),
            total(word(3, "the", "title"), word(3, "idiot", "body"),
                  keep=f"doc_key IN ({having('the', 'title')}) "
                       f"AND doc_key IN ({having('idiot', 'body')})"),
        ]
    ),
    "must_not": BASE
    + " UNION ALL ".join(
        [
            total(word(1, "in"), keep=f"doc_key NOT IN ({having('the')})"),
            total(word(2, "de"), word(2, "la"),
                  keep=f"doc_key IN ({having('de')}) AND doc_key NOT IN ({having('the', 'body')})"),
        ]
    ),
    "phrase": BASE
    + " UNION ALL ".join(
        _phrase_rows(q, words.split(), 0, None)
        for q, words in enumerate(["of the", "and attion to", "the the", "de la", "in the"], 1)
    ),
    "phrase_slop": BASE
    + " UNION ALL ".join(
        [
            _phrase_rows(1, ["of", "the"], 1, None),
            _phrase_rows(2, ["in", "to"], 2, "body"),
            _phrase_rows(3, ["la", "de"], 3, None),
            _phrase_rows(4, ["the", "and", "attion"], 2, "body"),
        ]
    ),
    "field_term": BASE
    + " UNION ALL ".join(
        [
            total(word(1, "the", "title")),
            total(word(2, "trash", "body")),
            total(by_id(3, "5")),
            total(by_id(4, "7"), word(4, "idiot", "body")),
        ]
    ),
    "stored_only": BASE + total(word(1, "trash")) + " UNION ALL " + total(word(4, "trash")),
    "boosted": BASE + total(word(1, "trash", None, 3.0), word(1, "idiot", "body", 0.5)),
    "term_range": BASE
    + " UNION ALL ".join(
        [
            "SELECT DISTINCT 1 AS qid, doc_key, 1e0 AS score FROM post "
            "WHERE field = 'body' AND term BETWEEN 'tra' AND 'trb'",
            "SELECT 2, doc_key, CAST(count(DISTINCT field) AS DOUBLE) FROM post "
            "WHERE term > 'zz' GROUP BY doc_key",
            "SELECT 3, doc_key, 1e0 FROM docs WHERE id >= '10' AND id < '12'",
            total(
                "SELECT DISTINCT 4 AS qid, doc_key, 1e0 AS s FROM post "
                "WHERE field = 'body' AND term <= '1'",
                word(4, "the"),
            ),
        ]
    ),
    "term_ranges_many": _with(*corpus(), REQUESTS) + """, spans AS (
      SELECT DISTINCT qid, unnest(words) AS w FROM request
    ), vocabulary AS (
      SELECT DISTINCT term FROM post WHERE field = 'body'
    ), met AS (
      SELECT DISTINCT qid, w, doc_key FROM spans
      JOIN vocabulary ON term >= w AND term < w || 'm'
      JOIN (SELECT doc_key, term FROM post WHERE field = 'body') USING (term)
    ), scored AS (
      SELECT qid, doc_key, CAST(count(*) AS DOUBLE) AS score FROM met GROUP BY ALL
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_key) AS rank FROM scored
    )
    SELECT qid, CAST(rank AS INTEGER) AS rank, CAST(doc_key AS VARCHAR) AS id, score FROM ranked WHERE rank <= 20""",
    "term_set": BASE
    + " UNION ALL ".join(
        [
            "SELECT 1 AS qid, doc_key, CAST(count(DISTINCT field) AS DOUBLE) AS score FROM post "
            "WHERE term IN ('trash', 'idiot') GROUP BY doc_key",
            "SELECT 2, doc_key, 2e0 FROM docs WHERE id IN ('1', '2', '3')",
            total(
                word(3, "the"),
                "SELECT DISTINCT 3 AS qid, doc_key, 1e0 AS s FROM post "
                "WHERE field = 'body' AND term IN ('under', 'ja')",
                keep=f"doc_key IN ({having('the')}) AND (doc_key IN ({having('under', 'body')}) "
                     f"OR doc_key IN ({having('ja', 'body')}))",
            ),
        ]
    ),
    "match_all": BY_LANGUAGE
    + "SELECT 1 AS qid, index_name, doc_key, 1e0 AS score FROM docs WHERE index_name = 'en' "
    "UNION ALL SELECT 2, index_name, doc_key, 1e0 FROM docs WHERE index_name = 'fr' "
    "AND doc_key NOT IN (SELECT doc_key FROM post WHERE term = 'de')",
    "bm25_topk": searched(20) + TOP,
    "phrase_bm25": BASE
    + " UNION ALL ".join(
        [
            total(_phrase_scores(1, ["of", "the"], 1.0)),
            total(_phrase_scores(2, ["and", "attion", "to"], 2.0)),
        ]
    ),
    "pruned_pool": searched(40, requests=SHORT) + "SELECT qid, doc_key, bm25, CAST(bm25_rank AS INTEGER) AS bm25_rank FROM pool",
    "overfetch_pool": searched(40)
    + "SELECT qid, CAST(bm25_rank AS INTEGER) AS bm25_rank, doc_key, bm25 FROM pool",
    "request_defaults": _with(REQUESTS)
    + """SELECT qid, array_to_string(words, ' ') AS q, 'default' AS index_name,
         CAST(CASE WHEN qid % 3 <> 0 THEN qid % 7 + 1 ELSE 20 END AS INTEGER) AS "limit",
         CASE WHEN qid % 4 <> 0 THEN qid % 4 = 1 ELSE FALSE END AS ai,
         least(greatest(CASE WHEN qid % 5 <> 0 THEN (qid % 5) * 0.5e0 - 0.6e0 ELSE 0.3e0 END, 0e0), 1e0)
           AS ai_weight FROM request""",
    "response_envelope": _with(
        *corpus(),
        """request0 AS (SELECT item_id AS qid, CASE WHEN item_id % 10 = 9 THEN 'nosuchword'
             ELSE text END AS text FROM benchmark)""",
        REQUESTS.replace("FROM benchmark", "FROM request0").replace("item_id AS qid", "qid"),
        QTERMS.format(index="'default'"),
        SCORED.format(pool=5),
    )
    + """SELECT r.qid, array_to_string(any_value(r.words), ' ') AS query, r.qid % 2 = 0 AS ai_enabled,
         CAST(count(doc_key) AS INTEGER) AS n_hits,
         coalesce(string_agg(concat_ws('|', CAST(doc_key AS VARCHAR), split_part(d.text, '.', 1),
             '{"lang":"' || d.lang || '","source":"' || d.source || '"}'), '; ' ORDER BY bm25_rank), '')
           AS hits
         FROM request r LEFT JOIN pool p ON p.qid = r.qid AND bm25_rank <= r.qid % 5 + 1
         LEFT JOIN documents d ON d.doc_id = p.doc_key GROUP BY r.qid""",
    "scoped_search": searched(20, "lang", scope="['en','fr','de','es','xx'][qid % 5 + 1]")
    + TOP.replace("SELECT qid,", "SELECT qid, index_name,"),
    "user_turn_search": searched(3, requests=TURNS) + TOP,
    "web_search": searched(20, "'web'", PAGES)
    + "SELECT qid, CAST(bm25_rank AS INTEGER) AS rank, id, url, bm25 AS score "
    "FROM pool JOIN docs USING (doc_key)",
    "cosine_pairs": "WITH v AS (SELECT vec_id AS a, CASE WHEN vec_id % 10 = 0 THEN "
    "list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS e FROM embeddings) "
    "SELECT x.a AS a, round(" + COSINE.format(a="x.e", b="y.e") + ", 6) AS cosine "
    "FROM v x JOIN v y ON y.a = x.a + 1",
    "vector_upsert_latest": f"WITH {HISTORY}, live AS (SELECT id, arg_max(embedding, n) AS e "
    "FROM history WHERE len(embedding) = 64 GROUP BY id) "
    "SELECT id, CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(unnest(e) AS DOUBLE) AS value FROM live",
    "stream_vectors": f"WITH {HISTORY}, live AS (SELECT id, arg_max(embedding, n) AS e "
    "FROM history WHERE len(embedding) = 64 GROUP BY id) "
    "SELECT id, CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(unnest(e) AS DOUBLE) AS value FROM live "
    "WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)",
    "vector_dims_reject": f"WITH {HISTORY} SELECT id, n, CAST(len(embedding) AS INTEGER) AS actual_dims "
    "FROM history WHERE len(embedding) <> 64",
    "vector_delete": "SELECT CAST(doc_id AS VARCHAR) AS id, "
    "doc_id IN (SELECT vec_id FROM embeddings) AS deleted FROM (SELECT DISTINCT doc_id FROM labels "
    "WHERE toxic = 1)",
    "vectors_left": "SELECT count(*) AS n, count(*) = 0 AS is_empty FROM embeddings "
    "WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "knn_topk": "WITH s AS (SELECT q.vec_id AS qid, CAST(v.vec_id AS VARCHAR) AS id, round("
    "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score "
    "FROM embeddings q, embeddings v), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid "
    "ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "knn_of_all": "WITH s AS (SELECT q.vec_id AS qid, CAST(v.vec_id AS VARCHAR) AS id, round("
    "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score "
    "FROM embeddings q, embeddings v), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid "
    "ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3",
    "knn_by_index": "WITH s AS (SELECT q.vec_id AS qid, 'part' || (v.label % 3) AS index_name, "
    "CAST(v.vec_id % 100 AS VARCHAR) AS id, round("
    "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score "
    "FROM embeddings q, embeddings v), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid "
    "ORDER BY score DESC, index_name, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "vector_object_import": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dims, "
    "round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
    "candidate_texts": "SELECT CAST(doc_id AS VARCHAR) AS id, "
    "split_part(text, '.', 1) || ' ' || text AS text FROM documents",
    "embed_documents": "WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, "
    "split_part(text, '.', 1) || ' ' || text AS x FROM documents) SELECT id, "
    f"CAST(unnest(range(8)) AS INTEGER) AS pos, unnest({letter_counts('x')}) AS value FROM t",
    "embed_once": "WITH t AS (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS x "
    "FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark "
    "UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), coalesce(text, '') "
    "FROM conversations) SELECT source, id, CAST(unnest(range(8)) AS INTEGER) AS pos, "
    f"unnest({letter_counts('x')}) AS value FROM t "
    "UNION ALL SELECT 'memo', 'texts', 0, CAST(count(DISTINCT x) AS DOUBLE) FROM t",
    "minmax_bm25": searched(40)
    + "SELECT qid, doc_key, round((bm25 - min(bm25) OVER (PARTITION BY qid)) / greatest("
    "max(bm25) OVER (PARTITION BY qid) - min(bm25) OVER (PARTITION BY qid), 1.1920929e-7), 6) "
    "AS bm25_norm FROM pool",
    "semantic_rerank": searched(40)
    + ", s AS (SELECT pool.qid AS qid, CAST(doc_key AS VARCHAR) AS id, bm25_rank, "
    f"round({AI}, 6) AS ai_score FROM pool {WITH_VECTORS}) "
    "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ai_score DESC, bm25_rank) AS INTEGER) "
    "AS rank, id, ai_score FROM s WHERE ai_score IS NOT NULL",
    "hybrid_search": searched(40)
    + _fused(AI, "least((pool.qid % 6) * 0.25e0, 1e0)", 20, extra=WITH_VECTORS),
    "rerank_fallback": searched(20)
    + _fused(AI, "0.3e0", 10, "pool.qid % 2 = 0 AND pool.qid % 3 <> 0", WITH_VECTORS),
    "rerank_on_the_fly": searched(40)
    + _fused(
        COSINE.format(a="qt.e", b="dt.e"),
        "0.5e0",
        20,
        extra="JOIN (SELECT doc_key, "
        + letter_counts("(title || ' ' || body)")
        + " AS e FROM docs) dt USING (doc_key) JOIN (SELECT qid, "
        + letter_counts("array_to_string(words, ' ')")
        + " AS e FROM request) qt ON qt.qid = pool.qid",
    ).replace("SELECT pool.*,", "SELECT pool.qid, pool.doc_key, pool.bm25, pool.bm25_rank,").replace(
        "OVER (PARTITION BY qid) AS low", "OVER (PARTITION BY pool.qid) AS low"
    ).replace("OVER (PARTITION BY qid) AS high", "OVER (PARTITION BY pool.qid) AS high"),
    "rerank_candidate_failure": searched(40)
    + _fused(
        COSINE.format(a="qt.e", b="dt.e"),
        "0.5e0",
        20,
        reranked="qt.good AND bool_and(dt.good) OVER (PARTITION BY pool.qid)",
        extra="JOIN (SELECT doc_key, length(title || ' ' || body) % 50 <> 0 AS good, "
        + letter_counts("(title || ' ' || body)")
        + " AS e FROM docs) dt USING (doc_key) JOIN (SELECT qid, "
        "length(array_to_string(words, ' ')) % 50 <> 0 AS good, "
        + letter_counts("array_to_string(words, ' ')")
        + " AS e FROM request) qt ON qt.qid = pool.qid",
    ).replace("SELECT pool.*,", "SELECT pool.qid, pool.doc_key, pool.bm25, pool.bm25_rank,").replace(
        "OVER (PARTITION BY qid) AS low", "OVER (PARTITION BY pool.qid) AS low"
    ).replace("OVER (PARTITION BY qid) AS high", "OVER (PARTITION BY pool.qid) AS high"),
    "empty_pools": searched(40)
    + _fused(AI, "0.3e0", 20, "q.embedding IS NOT NULL", WITH_VECTORS)
    + " AND qid % 3 = 2",
    "rerank_by_model": searched(40)
    + _fused(
        "(length(title || ' ' || body) % 100) / 50e0 - 1e0",
        "0.3e0",
        20,
        extra="JOIN docs USING (doc_key)",
    ).replace("SELECT pool.*,", "SELECT pool.qid, pool.doc_key, pool.bm25, pool.bm25_rank,"),
    "id_fill": "SELECT doc_id AS doc_key, CASE WHEN doc_id % 3 = 0 THEN 'made' "
    "ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents",
    "json_documents": "SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, '.', 1) AS title, "
    "text AS body, CAST(NULL AS VARCHAR) AS url, "
    "'{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS metadata FROM documents",
    "json_rejects": """
WITH forms AS (SELECT unnest(['lines', 'arrays']) AS form),
d AS (SELECT form, doc_id % 5 AS kind, CAST(doc_id AS VARCHAR) AS id, split_part(text, '.', 1) AS title
      FROM documents, forms)
SELECT form, CASE WHEN good THEN id END AS id,
       CASE WHEN good THEN title WHEN kind = 0 THEN 'not JSON' ELSE 'title is not a string' END AS title,
       CASE WHEN good THEN NULL WHEN kind = 0 THEN '{"id":"' || id || '","title":'
            ELSE '{"body":"b","id":"' || id || '","title":' || id || '}' END AS raw
FROM (SELECT *, NOT (kind = 1 OR kind = 0 AND form = 'lines') AS good FROM d)""",
    "storage_form": f"WITH {GAPS} SELECT id, title, coalesce(url, '') AS url, "
    "coalesce(metadata, '') AS metadata FROM gaps",
    "stored_fields": f"WITH {GAPS} SELECT id, title, nullif(url, '') AS url, "
    "CASE WHEN metadata = '{\"page\":1}' THEN metadata END AS metadata FROM gaps",
    "add_append": _copies("c2"),
    "delete_by_id": _copies("c3"),
    "snapshot_read": f"WITH {COMMITS} "
    + " UNION ALL ".join(
        f"SELECT lang AS index_name, count(*) AS n, {n} AS as_of FROM c{n} GROUP BY ALL"
        for n in (1, 2, 3, 4)
    ),
    "get_by_id": f"WITH {COMMITS} SELECT lang AS index_name, CAST(seq AS BIGINT) AS commit_seq, "
    "CAST(doc_id AS VARCHAR) AS id, split_part(text, '.', 1) AS title, text AS body "
    "FROM c4 WHERE lang = 'en' AND toxic = 1",
    "list_indexes": "SELECT DISTINCT lang AS index_name FROM documents",
    "store_search": searched(20, docs=STORE_DOCS, scope="'en'")
    + "SELECT qid, CAST(bm25_rank AS INTEGER) AS rank, CASE WHEN "
    "count(*) OVER (PARTITION BY qid, bm25) = 1 AND bm25 > min(bm25) OVER (PARTITION BY qid) "
    "THEN CAST(doc_key % 100000000 AS VARCHAR) END AS id, bm25 AS score FROM pool",
    "vectors_refilled": "WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, "
    "split_part(text, '.', 1) || ' ' || text AS x FROM documents) SELECT id, length(x) % 7 <> 0 AS at_once, "
    f"round(list_sum({letter_counts('x')}), 4) AS total FROM t",
    "store_vectors": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dims, "
    "round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings "
    "WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "stream_ingest": BASE
    + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tokens FROM post "
    "WHERE field = 'body' GROUP BY term",
    "stream_latency": """WITH e AS (
      SELECT event_type, value, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL
    ), span AS (
      SELECT max(t) - ((((max(t) - min(t)) // 3 + 1) // 1000000) + 1) * 1000000 AS closed FROM e
    )
    SELECT event_type, strftime(make_timestamp((t // 3600000000) * 3600000000), '%Y-%m-%d %H:%M') AS start,
      strftime(make_timestamp((t // 3600000000 + 1) * 3600000000), '%Y-%m-%d %H:%M') AS "end", count(*) AS n,
      quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
    FROM e, span WHERE value IS NOT NULL AND ((t // 3600000000) + 1) * 3600000000 <= (closed // 1000) * 1000
    GROUP BY ALL""",
    "latency_report": """SELECT event_type, count(*) AS n,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS qps,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
}
ORACLES["stream_search"] = ORACLES["store_search"]
