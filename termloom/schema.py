"""Row shapes shared by the package, and the defaults of a search request."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed request defaults.
DEFAULT_INDEX = "default"
DEFAULT_LIMIT = 20
DEFAULT_AI = False
DEFAULT_AI_WEIGHT = 0.3
DEFAULT_DIMS = 768
OVERFETCH = 2

# Fields of a document.  Only the first three can be searched, and only the
# first two are searched when a clause names no field.
DEFAULT_FIELDS = ("title", "body")
SEARCHABLE_FIELDS = ("title", "body", "id")
STORED_ONLY_FIELDS = ("url", "metadata")

# Scores are rounded before ranking, so that the order in which a cluster adds
# up doubles cannot change who wins.
SCORE_DIGITS = 6

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("metadata", T.VariantType()),
    ]
)

VECTOR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("q", T.StringType()),
        T.StructField("index_name", T.StringType()),
        T.StructField("limit", T.IntegerType()),
        T.StructField("ai", T.BooleanType()),
        T.StructField("ai_weight", T.DoubleType()),
    ]
)

CLAUSE = T.StructType(
    [
        T.StructField("occur", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("lower", T.StringType()),
        T.StructField("upper", T.StringType()),
        T.StructField("incl_lower", T.BooleanType()),
        T.StructField("incl_upper", T.BooleanType()),
        T.StructField("slop", T.IntegerType()),
        T.StructField("boost", T.DoubleType()),
    ]
)

CLAUSES = T.ArrayType(CLAUSE)
