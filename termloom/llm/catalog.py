"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import (
    ann,
    byte_bpe,
    decontaminate,
    html_text,
    jaccard_join,
    line_dedup,
    periodic_runs,
    repeats,
    secret_scan,
    source_divergence,
    toxicity,
    url_filter,
    warc,
)
from termloom.llm.common import table
from termloom.session import work_folder

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The given rules of the URL filter.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur anywhere else too."""
    rows = repeats.remove_repeats(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def token_digests(docs: DataFrame, vocab: byte_bpe.Vocabulary) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(docs, vocab, public_tokenizers.PATTERN), vocab)
    return rows.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text and their decoding, as digests."""
    vocab = byte_bpe.load_vocabulary(public_tokenizers.path(RANKS))
    return token_digests(table(spark, folder, "documents").select("doc_id", "text"), vocab)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that nearly repeat an earlier line, anywhere; one row a document."""
    rows = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_lines",
        "n_joined",
        F.size("removed").cast("long").alias("n_removed"),
        F.to_json(F.sort_array("removed")).alias("removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL; labelled pages that are toxic or of low quality teach the method."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") > 0) | (F.col("quality") < 1)).alias("block")
    )
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), labels, URL_RULES)


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows found for each embedding whose id is divisible by 20."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text: by fixed patterns, and by formats learnt from those."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = secret_scan.scan(docs, secret_scan.train(docs))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives, then found through the index and read back."""
    archives = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, folder, "pages")
    index = warc.build_index(warc.write_archives(pages, archives))
    keys = pages.select(
        warc.url_key(F.col("url")).alias("url_key"), F.coalesce(F.col("page_id").cast("long"), F.lit(warc.NO_ID)).alias("id")
    )
    rows = warc.read_ranges(warc.look_up(index, keys), archives)
    response = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Test items that each text holds, in one piece or in several."""
    rows = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "contaminated", "n_items", "items", F.round("max_coverage", 6).alias("max_coverage"))


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")) % 5 == 0


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learnt from the labels outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels").where(~_held_out()))
    return toxicity.score(docs, model).select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_offending",
        "offending",
    )


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are alike to 0.75 or more."""
    rows = jaccard_join.jaccard_components(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


def _with_repetition(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the hash of doc_id, repeat some of their words to the end."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    sized = parts.select("*", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    left = F.col("n") - F.col("a")
    p = (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil(left / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), times)), F.lit(1), left)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words that repeat with a fixed period, and the texts without the repetitions."""
    rows = periodic_runs.find_runs(_with_repetition(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    picked = rows.select("*", longest.alias("longest"), F.array_join(lines, "").alias("lines"))
    length, period = F.col("longest.length"), -F.col("longest.col3")
    return picked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page, by a tree learnt from the package's labelled table."""
    return html_text.extract(table(spark, folder, "pages"), html_text.train())


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every source from each other one of its language, and the terms that mark it."""
    return source_divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_nearest": op4_nearest,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_html_text": op12_html_text,
    "op13_source_divergence": op13_source_divergence,
}

#: SQL for the queries that it can express; the others are tested by brute force.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH b AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), strings AS (
            SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM b)
        ), again AS (
            SELECT doc_id, i FROM strings JOIN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1) USING (m)
        ), cut AS (
            SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again)
        ), runs AS (
            SELECT doc_id, min(i) AS first, max(i) + 200 AS last FROM cut GROUP BY doc_id, run
        ), per AS (
            SELECT doc_id, sum(last - first) AS removed, count(*) AS spans,
                list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts
            FROM runs GROUP BY doc_id
        ), whole AS (
            SELECT b.doc_id, h, n, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans,
                list_prepend(0, coalesce(lasts, [])) AS starts, list_append(coalesce(firsts, []), n) AS ends
            FROM b LEFT JOIN per ON b.doc_id = per.doc_id
        )
        SELECT doc_id, n AS n_bytes, removed AS n_removed, spans AS n_spans,
            sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1),
                lambda j: substr(h, 2 * starts[j] + 1, 2 * (ends[j] - starts[j]))), ''))) AS kept_sha256
        FROM whole
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                END AS shingles
            FROM w
        ), e AS (
            SELECT doc_id, unnest(shingles) AS shingle FROM s
        ), n AS (
            SELECT doc_id, len(shingles) AS n FROM s
        ), pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
            FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
            WHERE 100 * shared >= 75 * (p.n + q.n - shared)
        ), ways AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM n
            UNION
            SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.other = ways.x
        )
        SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n
    """,
    "op3_url_filter": r"""
        WITH a AS (
            SELECT page_id, url,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), b AS (
            SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
        ), c AS (
            SELECT page_id, url, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
            FROM b
        ), r(verdict, name, start) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), fit AS (
            SELECT page_id, url, arg_max(name || start, length(name || start)) AS rule,
                arg_max(verdict, length(name || start)) AS verdict
            FROM c JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
            GROUP BY page_id, url
        ), d AS (
            SELECT c.*, list_sort(list_distinct(
                list_transform(list_filter(string_split(host, '.'), lambda t: t <> ''), lambda t: 'host:' || t) ||
                list_transform(list_filter(string_split_regex(lower(path), '[^a-z0-9-]+'), lambda t: t <> ''), lambda t: 'path:' || t))) AS tokens
            FROM c
        ), known AS (
            SELECT doc_id, bool_or(toxic > 0 OR quality < 1) AS block FROM labels GROUP BY doc_id
        ), labelled AS (
            SELECT tokens, block FROM d JOIN known ON page_id = doc_id WHERE block IS NOT NULL AND len(tokens) > 0
        ), subsets AS (
            SELECT list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS tokens, block
            FROM (SELECT tokens, block, unnest(range(1, 1 << len(tokens))) AS mask FROM labelled)
        ), mined AS (
            SELECT tokens FROM subsets GROUP BY tokens
            HAVING count(*) FILTER (WHERE block) >= greatest(20, (SELECT ceil(count(*) * 0.002) FROM labelled))
                AND count(*) FILTER (WHERE block) >= 0.7 * count(*)
        )
        SELECT d.page_id, host, path, rule, coalesce(verdict,
            CASE WHEN EXISTS (SELECT 1 FROM mined WHERE list_has_all(d.tokens, mined.tokens)) THEN 'block' ELSE 'allow' END) AS verdict
        FROM d LEFT JOIN fit ON d.page_id = fit.page_id AND d.url = fit.url
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest) AS main FROM d
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> main THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> main THEN main END AS refers_to
        FROM g
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), t AS (
            SELECT lang, source, row, unnest(terms) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
        ), l AS (
            SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang
        ), g AS (
            SELECT lang, source, coalesce(any_value(total), 0) AS total
            FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
            GROUP BY lang, source
        ), p AS (
            SELECT g.lang, g.source, k.term, c.n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
                1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (l.total + l.v) AS q
            FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
