"""Query predicates as a table of clauses.

A request row carries either plain words in ``q`` or an array of clauses.  The
builders below make clause rows from Python; :func:`compile_requests` turns a
table of requests into flat term, phrase and range tables that the matcher can
join with postings.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.text import analyze_with_offsets
from termloom.schema import (
    CLAUSE,
    CLAUSES,
    DEFAULT_AI,
    DEFAULT_AI_WEIGHT,
    DEFAULT_FIELDS,
    DEFAULT_INDEX,
    DEFAULT_LIMIT,
    SEARCHABLE_FIELDS,
    STORED_ONLY_FIELDS,
)
from termloom.session import scratch_table

OCCURS = ("should", "must", "must_not")
KINDS = ("term", "phrase", "range", "set", "all")
# Kinds that look up terms.
TERM_KINDS = ("term", "set", "all")

# Each document has one posting with this term per field.  It carries the field
# length, so corpus totals and match-all are ordinary term lookups.
DOC_MARKER = ""


def _clause(kind: str, occur: str, field: str | None, boost: float, **values) -> dict:
    if occur not in OCCURS:
        raise ValueError(f"occur must be one of {OCCURS}, got {occur!r}")
    if field in STORED_ONLY_FIELDS:
        raise ValueError(f"field {field!r} is stored but not searchable")
    if field is not None and field not in SEARCHABLE_FIELDS:
        raise ValueError(f"unknown field {field!r}")
    row = dict.fromkeys(CLAUSE.names)
    row.update(kind=kind, occur=occur, field=field, boost=float(boost), slop=0, **values)
    return row


def term(text: str, field: str | None = None, occur: str = "should", boost: float = 1.0) -> dict:
    """One word; a word that splits into several tokens becomes a phrase."""
    return _clause("term", occur, field, boost, text=text)


def phrase(
    text: str, field: str | None = None, slop: int = 0, occur: str = "should", boost: float = 1.0
) -> dict:
    """Consecutive words; ``slop`` is the total displacement allowed between them."""
    if slop < 0:
        raise ValueError("slop must not be negative")
    row = _clause("phrase", occur, field, boost, text=text)
    row["slop"] = slop
    return row


def term_range(
    field: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    incl_lower: bool = True,
    incl_upper: bool = True,
    occur: str = "should",
    boost: float = 1.0,
) -> dict:
    """Terms between two bounds in byte order; every match scores ``boost``."""
    if lower is None and upper is None:
        raise ValueError("a range needs at least one bound")
    return _clause(
        "range", occur, field, boost,
        lower=lower, upper=upper, incl_lower=incl_lower, incl_upper=incl_upper,
    )


def term_set(
    terms: Iterable[str], field: str | None = None, occur: str = "should", boost: float = 1.0
) -> dict:
    """Any of the listed terms; every match scores ``boost``."""
    return _clause("set", occur, field, boost, terms=list(terms))


def match_all(occur: str = "should", boost: float = 1.0) -> dict:
    """Every live document, score ``boost``."""
    return _clause("all", occur, None, boost)


def validate(clauses: list[dict]) -> list[dict]:
    """Reject a query that only excludes."""
    if clauses and all(c["occur"] == "must_not" for c in clauses):
        raise ValueError("a query with only must_not clauses matches nothing")
    return clauses


def clause_requests(spark: SparkSession, requests: Iterable[dict]) -> DataFrame:
    """Request table from Python dicts with ``qid`` and ``q`` or ``clauses``."""
    schema = T.StructType(
        [
            T.StructField("qid", T.LongType()),
            T.StructField("q", T.StringType()),
            T.StructField("clauses", CLAUSES),
            T.StructField("index_name", T.StringType()),
            T.StructField("limit", T.IntegerType()),
            T.StructField("ai", T.BooleanType()),
            T.StructField("ai_weight", T.DoubleType()),
        ]
    )
    rows = []
    for request in requests:
        clauses = request.get("clauses")
        if clauses is not None:
            validate(clauses)
        limit = request.get("limit")
        if limit is not None and limit < 1:
            raise ValueError("limit must be at least 1")
        rows.append(tuple(request.get(name) for name in schema.names))
    return spark.createDataFrame(rows, schema)


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill in absent request settings: index, limit, ai, ai_weight."""

    def setting(name: str, kind: str, default) -> Column:
        value = F.lit(default).cast(kind)
        if name in requests.columns:
            value = F.coalesce(F.col(name).cast(kind), value)
        return value.alias(name)

    clauses = F.col("clauses") if "clauses" in requests.columns else F.lit(None)
    q = F.col("q") if "q" in requests.columns else F.lit(None)
    return requests.select(
        "qid",
        q.cast("string").alias("q"),
        clauses.cast(CLAUSES).alias("clauses"),
        setting("index_name", "string", DEFAULT_INDEX),
        setting("limit", "int", DEFAULT_LIMIT),
        setting("ai", "boolean", DEFAULT_AI),
        F.least(
            F.greatest(setting("ai_weight", "double", DEFAULT_AI_WEIGHT), F.lit(0.0)), F.lit(1.0)
        ).alias("ai_weight"),
    )


# One row per token, set member or bound of a clause.
_FLAT = (
    "qid", "index_name", "clause_id", "occur", "kind", "field", "offset", "term",
    "n_terms", "slop", "boost", "lower", "upper", "incl_lower", "incl_upper",
)


def _word_rows(requests: DataFrame) -> DataFrame:
    """Plain words as ``should`` terms; a word of several tokens is a phrase."""
    words = requests.select(
        "qid", "index_name", F.posexplode(F.split("q", r"\s+")).alias("clause_id", "word")
    )
    tokens = words.select(
        "qid", "index_name", "clause_id", analyze_with_offsets("word").alias("tokens")
    )
    rows = tokens.select(
        "qid", "index_name", "clause_id", F.size("tokens").alias("n_terms"), F.inline("tokens")
    )
    return rows.withColumns(
        {
            "occur": F.lit("should"),
            "kind": F.when(F.col("n_terms") == 1, F.lit("term")).otherwise(F.lit("phrase")),
            "field": F.lit(None).cast("string"),
            "slop": F.lit(0),
            "boost": F.lit(1.0),
            "lower": F.lit(None).cast("string"),
            "upper": F.lit(None).cast("string"),
            "incl_lower": F.lit(None).cast("boolean"),
            "incl_upper": F.lit(None).cast("boolean"),
        }
    ).select(*_FLAT)


def _problem(clause: Column) -> Column:
    """What is wrong with a clause that came in a table; NULL if nothing is."""

    def outside(name: str, values: tuple[str, ...]) -> Column:
        return ~F.coalesce(clause[name].isin(*values), F.lit(False))

    kind = clause["kind"]
    no_bound = clause["lower"].isNull() & clause["upper"].isNull()
    no_slop = (kind == "phrase") & (F.coalesce(clause["slop"], F.lit(-1)) < 0)
    return (
        F.when(clause.isNull(), "clause is missing")
        .when(outside("kind", KINDS), "unknown kind")
        .when(outside("occur", OCCURS), "unknown occur")
        .when(clause["field"].isNotNull() & outside("field", SEARCHABLE_FIELDS), "field cannot be searched")
        .when(clause["boost"].isNull() | F.isnan(clause["boost"]), "boost is missing")
        .when(kind.isin("term", "phrase") & clause["text"].isNull(), "text is missing")
        .when(no_slop, "slop is missing or negative")
        .when((kind == "range") & no_bound, "a range needs at least one bound")
        .when((kind == "set") & clause["terms"].isNull(), "terms are missing")
    )


def _clause_rows(requests: DataFrame) -> DataFrame:
    """One row per token, set member or bound; a bad clause fails the query that reads it."""
    only_excludes = (F.size("clauses") > 0) & F.forall("clauses", lambda c: c["occur"] == "must_not")
    opened = requests.select(
        "qid", "index_name", only_excludes.alias("negative"), F.posexplode("clauses").alias("clause_id", "c")
    )
    problem = F.coalesce(
        _problem(F.col("c")), F.when(F.col("negative"), "a query with only must_not clauses matches nothing")
    )
    failure = F.raise_error(
        F.concat(F.lit("request "), F.coalesce(F.col("qid").cast("string"), F.lit("NULL")), F.lit(": "), problem)
    )
    # Every column comes out of the checked clause, so none can be read past the check.
    opened = opened.select(
        "qid", "index_name", "clause_id", F.when(problem.isNull(), F.col("c")).otherwise(failure).alias("c")
    ).select("qid", "index_name", "clause_id", "c.*")
    whole = F.col("field") == "id"
    is_text = F.col("kind").isin("term", "phrase")

    def single(term_col: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("offset"), term_col.alias("term")))

    def cased(name: str) -> Column:
        return F.when(whole, F.col(name)).otherwise(F.lower(name))

    listed = F.array_distinct(
        F.transform("terms", lambda t: F.when(whole, t).otherwise(F.lower(t)))
    )
    tokens = (
        F.when(is_text & whole, single(F.col("text")))
        .when(is_text, analyze_with_offsets("text"))
        .when(
            F.col("kind") == "set",
            F.transform(listed, lambda t: F.struct(F.lit(0).alias("offset"), t.alias("term"))),
        )
        .otherwise(single(F.lit(DOC_MARKER)))
    )
    measured = opened.withColumn("tokens", tokens).withColumn("n_terms", F.size("tokens"))
    # An empty set stays as a row that can match nothing, so a must on it fails.
    return (
        measured.where(~is_text | (F.col("n_terms") > 0))
        .select("*", F.inline_outer("tokens"))
        .withColumns(
            {
                "kind": F.when(is_text & (F.col("n_terms") == 1), F.lit("term"))
                .when(is_text, F.lit("phrase"))
                .otherwise(F.col("kind")),
                "lower": cased("lower"),
                "upper": cased("upper"),
            }
        )
        .where((F.col("kind") != "set") | F.col("term").isNull() | (F.col("term") != DOC_MARKER))
        .select(*_FLAT)
    )


def _flat_rows(filled: DataFrame, has_clauses: bool) -> DataFrame:
    if not has_clauses:
        return _word_rows(filled)
    words = _word_rows(filled.where(F.col("clauses").isNull()))
    return words.unionByName(_clause_rows(filled.where(F.col("clauses").isNotNull())))


@dataclass(frozen=True)
class Profile:
    """What a batch of requests needs, from one aggregate over the request table."""

    queries: int
    max_limit: int
    min_limit: int
    max_clauses: int
    term_rows: int
    text_bytes: int
    any_must: bool
    any_must_not: bool
    any_term: bool
    any_set: bool
    any_all: bool
    any_range: bool
    any_phrase: bool
    any_id: bool

    @property
    def fields(self) -> tuple[str, ...]:
        return SEARCHABLE_FIELDS if self.any_id else DEFAULT_FIELDS

    @property
    def plain(self) -> bool:
        """Only scored ``should`` terms."""
        return not (
            self.any_must
            or self.any_must_not
            or self.any_set
            or self.any_all
            or self.any_range
            or self.any_phrase
        )


TERM_KEY = ("index_name", "field", "term")


@dataclass(frozen=True)
class CompiledRequests:
    requests: DataFrame
    terms: DataFrame
    phrases: DataFrame | None
    ranges: DataFrame | None
    wanted: DataFrame
    profile: Profile
    literal: tuple[str, ...] | None = None


# Batches up to this many flat rows are compiled on the spot and kept as local
# relations; larger ones stay distributed tables.
LOCAL_ROWS = 20_000

_HEAD = (
    ("index_name", pa.string()), ("required", pa.int64()),
    ("clause_id", pa.int32()), ("occur", pa.string()),
)
_TERMS = (*_HEAD, ("kind", pa.string()), ("field", pa.string()), ("term", pa.string()),
          ("boost", pa.float64()))
_PHRASES = (*_HEAD, ("field", pa.string()), ("offset", pa.int32()), ("term", pa.string()),
            ("n_terms", pa.int32()), ("slop", pa.int32()), ("boost", pa.float64()))
_RANGES = (*_HEAD, ("field", pa.string()), ("lower", pa.string()), ("upper", pa.string()),
           ("incl_lower", pa.bool_()), ("incl_upper", pa.bool_()), ("boost", pa.float64()))
_WANTED = (("index_name", pa.string()), ("field", pa.string()), ("term", pa.string()))
MASK_CLAUSES = 63


def compile_requests(requests: DataFrame) -> CompiledRequests:
    """Flatten requests into joinable clause tables.

    ``terms``   (qid, index_name, required, clause_id, occur, kind, field, term, boost)
    ``phrases`` (qid, index_name, required, clause_id, occur, field, offset, term,
                n_terms, slop, boost)
    ``ranges``  (qid, index_name, required, clause_id, occur, field, lower, upper,
                incl_lower, incl_upper, boost)
    ``wanted``  distinct (index_name, field, term) to look up, field markers included

    ``required`` is the bit set of the must clauses for up to 63 clauses per
    request, and their number beyond that.
    """
    filled = with_defaults(requests)
    flat = _flat_rows(filled, "clauses" in requests.columns)
    heads = filled.select("qid", "q", "index_name", "limit", "ai", "ai_weight")
    few_rows = flat.limit(LOCAL_ROWS + 1).toArrow()
    few_heads = heads.limit(LOCAL_ROWS + 1).toArrow()
    if max(few_rows.num_rows, few_heads.num_rows) <= LOCAL_ROWS:
        spark = requests.sparkSession
        return _compile_local(spark, few_rows.to_pylist(), few_heads)
    return _compile_distributed(flat, heads)


def _checked(profile: Profile) -> Profile:
    if profile.min_limit < 1:
        raise ValueError("limit must be at least 1")
    return profile


def _compile_local(spark, rows: list[dict], heads: pa.Table) -> CompiledRequests:
    requests = spark.createDataFrame(heads)
    qid_type = heads.schema.field("qid").type
    heads = heads.to_pylist()
    limits = [h["limit"] for h in heads] or [1]
    has = lambda column, value: any(r[column] == value for r in rows)
    profile = _checked(
        Profile(
            queries=len(heads),
            max_limit=max(limits),
            min_limit=min(limits),
            max_clauses=max((r["clause_id"] for r in rows), default=-1) + 1,
            term_rows=len(rows) * len(DEFAULT_FIELDS),
            text_bytes=sum(len((r["term"] or "").encode()) + 64 for r in rows) * len(DEFAULT_FIELDS),
            any_must=has("occur", "must"),
            any_must_not=has("occur", "must_not"),
            any_term=any(r["kind"] in TERM_KINDS for r in rows),
            any_set=has("kind", "set"),
            any_all=has("kind", "all"),
            any_range=has("kind", "range"),
            any_phrase=has("kind", "phrase"),
            any_id=has("field", "id"),
        )
    )
    must: dict = {}
    for r in rows:
        if r["occur"] == "must":
            must.setdefault(r["qid"], set()).add(r["clause_id"])
    if profile.max_clauses <= MASK_CLAUSES:
        required = {q: sum(1 << c for c in ids) for q, ids in must.items()}
    else:
        required = {q: len(ids) for q, ids in must.items()}

    weights: dict = {}
    phrases, ranges, wanted = [], [], set()
    for r in rows:
        if r["kind"] == "all":
            fields = DEFAULT_FIELDS[:1]
        else:
            fields = (r["field"],) if r["field"] is not None else DEFAULT_FIELDS
        head = (r["qid"], r["index_name"], required.get(r["qid"], 0))
        for field in fields:
            bounds = (r["lower"], r["upper"], r["incl_lower"], r["incl_upper"])
            if r["kind"] == "range":
                ranges.append((*head, r["clause_id"], r["occur"], field, *bounds, r["boost"]))
                continue
            wanted.update((r["index_name"], field, t) for t in (r["term"], DOC_MARKER))
            if r["kind"] == "phrase":
                place = (r["offset"], r["term"], r["n_terms"], r["slop"], r["boost"])
                phrases.append((*head, r["clause_id"], r["occur"], field, *place))
                continue
            # Scores add up, so a word that a plain query repeats is one weight.
            clause = 0 if profile.plain else r["clause_id"]
            key = (*head, clause, r["occur"], r["kind"], field, r["term"])
            weights[key] = weights.get(key, 0.0) + r["boost"]

    def make(values: list[tuple], fields, with_qid: bool = True) -> DataFrame:
        fields = [("qid", qid_type), *fields] if with_qid else fields
        columns = list(zip(*values)) or [()] * len(fields)
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)]
        return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))

    terms = [(*key, boost) for key, boost in weights.items()]
    looked_up = [w for w in wanted if w[2] is not None]
    return CompiledRequests(
        requests,
        make(terms, _TERMS),
        make(phrases, _PHRASES) if phrases else None,
        make(ranges, _RANGES) if ranges else None,
        make(looked_up, _WANTED, with_qid=False),
        profile,
        tuple(sorted({w[2] for w in looked_up})),
    )


def _compile_distributed(flat: DataFrame, heads: DataFrame) -> CompiledRequests:
    # Many tables derive from the rows, and each would analyze the requests again.
    flat = scratch_table(flat)
    profile = _checked(_profile(flat, heads))
    required = F.lit(0).cast("long")
    if profile.any_must:
        must = flat.where(F.col("occur") == "must")
        if profile.max_clauses <= MASK_CLAUSES:
            value = F.bit_or(clause_bit(F.col("clause_id")))
        else:
            value = F.count_distinct("clause_id")
        flat = flat.join(must.groupBy("qid").agg(value.alias("mask")), "qid", "left")
        required = F.coalesce("mask", required)
    default = F.array(*[F.lit(f) for f in DEFAULT_FIELDS])
    fields = (
        F.when(F.col("kind") == "all", F.array(F.lit(DEFAULT_FIELDS[0])))
        .when(F.col("field").isNotNull(), F.array("field"))
        .otherwise(default)
    )
    rows = flat.withColumn("required", required).withColumn("field", F.explode(fields))
    head = ["qid", "index_name", "required", "clause_id", "occur"]
    terms = rows.where(F.col("kind").isin(*TERM_KINDS))
    if profile.plain:
        terms = terms.withColumn("clause_id", F.lit(0))
    terms = terms.groupBy(*head, "kind", "field", "term").agg(F.sum("boost").alias("boost"))
    phrases = rows.where(F.col("kind") == "phrase").select(
        *head, "field", "offset", "term", "n_terms", "slop", "boost"
    )
    ranges = rows.where(F.col("kind") == "range").select(
        *head, "field", "lower", "upper", "incl_lower", "incl_upper", "boost"
    )
    looked_up = rows.where((F.col("kind") != "range") & F.col("term").isNotNull())
    wanted = looked_up.select(
        "index_name", "field", F.explode(F.array(F.col("term"), F.lit(DOC_MARKER))).alias("term")
    ).distinct()
    return CompiledRequests(heads, terms, phrases, ranges, wanted, profile)


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def _profile(flat: DataFrame, heads: DataFrame) -> Profile:
    size = F.coalesce(F.octet_length("term"), F.lit(0)) + 64
    clauses = flat.agg(
        (F.coalesce(F.max("clause_id"), F.lit(-1)) + 1).alias("max_clauses"),
        (F.count(F.lit(1)) * len(DEFAULT_FIELDS)).alias("term_rows"),
        (F.coalesce(F.sum(size), F.lit(0)) * len(DEFAULT_FIELDS)).alias("text_bytes"),
        _any(F.col("occur") == "must").alias("any_must"),
        _any(F.col("occur") == "must_not").alias("any_must_not"),
        _any(F.col("kind").isin(*TERM_KINDS)).alias("any_term"),
        _any(F.col("kind") == "set").alias("any_set"),
        _any(F.col("kind") == "all").alias("any_all"),
        _any(F.col("kind") == "range").alias("any_range"),
        _any(F.col("kind") == "phrase").alias("any_phrase"),
        _any(F.col("field") == "id").alias("any_id"),
    ).first()
    limits = heads.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.max("limit"), F.lit(1)).alias("max_limit"),
        F.coalesce(F.min("limit"), F.lit(1)).alias("min_limit"),
    ).first()
    return Profile(**clauses.asDict(), **limits.asDict())


def clause_bit(clause_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), clause_id)
