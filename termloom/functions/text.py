"""Text analysis as column expressions.

The default analyzer splits on everything that is not alphabetic or
a number, drops tokens of 40 bytes or more, then lower-cases what is left.  All
of it is built from Spark functions, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the analyzer.
TOKEN_PATTERN = r"[\p{IsAlphabetic}\p{N}]+"
MAX_TOKEN_BYTES = 40


def raw_tokens(text: Column | str) -> Column:
    """Every token of ``text`` in order, before the length filter."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def is_indexed_token(token: Column | str) -> Column:
    return F.octet_length(token) < MAX_TOKEN_BYTES


def analyze(text: Column | str) -> Column:
    """``ARRAY<STRING>`` of the terms of ``text``, long tokens removed."""
    kept = F.filter(raw_tokens(text), is_indexed_token)
    return F.transform(kept, F.lower)


def analyze_with_offsets(text: Column | str) -> Column:
    """``ARRAY<STRUCT<offset, term>>``; a dropped token leaves a gap in ``offset``."""
    tagged = F.transform(
        raw_tokens(text),
        lambda token, i: F.struct(i.alias("offset"), token.alias("token")),
    )
    kept = F.filter(tagged, lambda t: is_indexed_token(t["token"]))
    return F.transform(
        kept, lambda t: F.struct(t["offset"].alias("offset"), F.lower(t["token"]).alias("term"))
    )


def candidate_text(title: str = "title", body: str = "body") -> Column:
    """Text handed to an embedding model: title, one space, body."""
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit("")))
