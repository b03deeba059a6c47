"""Range clauses: documents with a term between two bounds, for any number of ranges.

All bounds and all distinct terms are sorted together once.  The bounds cut
the order of terms into numbered segments; a term lies in one segment and a
range covers a run of them.  Runs are put together from few aligned blocks of
segments (dyadic nodes), so ranges meet terms by equality of nodes: a wide
range costs as much as a narrow one, and no (range, term) pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from termloom.operators.clauses import DOC_MARKER, TERM_KEY
from termloom.session import repartitioned, scratch_table

# A place between terms: (far, bound, side).  Side 0 lies before the term that
# equals the bound, 1 is the term itself, 2 lies after it; far is 1 after all.
POINT = ("far", "bound", "side")
NODE = ("level", "node")

# Different ranges up to this count are brought to the driver to filter the scan,
# by up to so many stretches of terms for each field.
KNOWN_SPANS = 2_000
LITERAL_SPANS = 32
# Bounds up to this count become a search tree in an expression; more are sorted with the terms.
LITERAL_BOUNDS = 256


def _point(far: Column, bound: Column, side: Column, suffix: str = "") -> list[Column]:
    return [c.cast(t).alias(n + suffix) for n, c, t in zip(POINT, (far, bound, side), ("int", "string", "int"))]


def with_points(ranges: DataFrame) -> DataFrame:
    """``ranges`` with their ends as points; ranges that can hold nothing are left out."""
    after = lambda inside: F.when(inside, F.lit(0)).otherwise(F.lit(2))
    lower, upper = F.col("lower"), F.col("upper")
    start = _point(F.lit(0), F.coalesce(lower, F.lit(DOC_MARKER)), after(lower.isNotNull() & F.col("incl_lower")), "_1")
    end = _point(
        F.when(upper.isNull(), F.lit(1)).otherwise(F.lit(0)),
        F.coalesce(upper, F.lit("")),
        F.when(upper.isNotNull() & F.col("incl_upper"), F.lit(2)).otherwise(F.lit(0)),
        "_2",
    )
    first, last = (F.struct(*(F.col(n + s).alias(n) for n in POINT)) for s in ("_1", "_2"))
    return ranges.select("*", *start, *end).where(first < last)


def _widest(ranges: DataFrame) -> list[Row]:
    """(field, lower, upper) around all ranges of each field, null where one is open."""
    rows = ranges.groupBy("field").agg(
        F.when(F.max(F.col("lower").isNull()), None).otherwise(F.min("lower")).alias("lower"),
        F.when(F.max(F.col("upper").isNull()), None).otherwise(F.max("upper")).alias("upper"),
    )
    return rows.collect()  # one row for each searchable field


def merged(spans: Iterable[Row], most: int = LITERAL_SPANS) -> list[tuple[str, str | None, str | None]]:
    """(field, lower, upper) of spans that touch, put together; neighbours too, until ``most`` are left to a field."""
    out = []
    for field in sorted({s["field"] for s in spans}):
        own = sorted((((s["lower"] or "").encode(), s["upper"]) for s in spans if s["field"] == field), key=lambda x: x[0])
        joined: list[list] = []
        for lower, upper in own:
            end = None if upper is None else upper.encode()
            if joined and (joined[-1][1] is None or lower <= joined[-1][1]):
                joined[-1][1] = None if end is None or joined[-1][1] is None else max(joined[-1][1], end)
            else:
                joined.append([lower, end])
        size = -(-len(joined) // most)
        for i in range(0, len(joined), size):
            lower, upper = joined[i][0], joined[min(i + size, len(joined)) - 1][1]
            out.append((field, lower.decode() or None, None if upper is None else upper.decode()))
    return out


def scan_filter(ranges: DataFrame) -> Column:
    """A filter for the scan that all terms of any range pass, and few others.

    Of up to ``KNOWN_SPANS`` different ranges it names the stretches that they
    cover together; of more, only the widest bounds of each field.
    """
    spans = ranges.select("field", "lower", "upper").distinct().limit(KNOWN_SPANS + 1).collect()
    if len(spans) > KNOWN_SPANS:
        spans = _widest(ranges)
    condition = F.lit(False)
    for field, lower, upper in merged(spans):
        inside = (F.col("field") == field) & (F.col("term") != DOC_MARKER)
        if lower is not None:
            inside &= F.col("term") >= lower
        if upper is not None:
            inside &= F.col("term") <= upper
        condition |= inside
    return condition


def _ends(ranges: DataFrame) -> DataFrame:
    """Both ends of all ranges, and by how many ranges are open after each."""
    ends = [
        ranges.select("index_name", "field", *(F.col(n + s).alias(n) for n in POINT), F.lit(change).alias("change"))
        for s, change in (("_1", 1), ("_2", -1))
    ]
    return ends[0].union(ends[1])


def segment_of(bounds: Sequence[Row]) -> tuple[Column, list[int]]:
    """The segment that a term lies in, as an expression that halves the bounds at each step.

    Also the number of each bound in the order of all.
    """
    place = lambda i: (bounds[i]["index_name"], bounds[i]["field"])
    order = sorted(range(len(bounds)), key=lambda i: (*place(i), bounds[i]["far"], bounds[i]["bound"].encode(), bounds[i]["side"]))
    number = [0] * len(bounds)
    for n, i in enumerate(order, 1):
        number[i] = n

    def passed(i: int) -> Column:
        if bounds[i]["far"]:
            return F.lit(False)
        return F.col("term") >= bounds[i]["bound"] if bounds[i]["side"] == 0 else F.col("term") > bounds[i]["bound"]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(passed(order[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    segment = F.lit(None).cast("long")
    for index, field in sorted({place(i) for i in order}):
        own = [n for n, i in enumerate(order) if place(i) == (index, field)]
        here = (F.col("index_name") == index) & (F.col("field") == field)
        segment = F.when(here, search(own[0], own[-1] + 1)).otherwise(segment)
    return segment, number


def sorted_marks(ranges: DataFrame, terms: DataFrame) -> DataFrame:
    """Bounds and terms in one order: (index_name, field, far, bound, side, segment).

    ``segment`` counts the distinct bounds up to a row, over all indexes and
    fields.  Terms outside of all ranges are left out.  The order is made by a
    range partitioning; only one row for each of its partitions meets the others.
    """
    place = ["index_name", "field", *POINT]
    cuts = _ends(ranges).groupBy(*place).agg(F.sum("change").alias("change"), F.lit(1).alias("cut"))
    words = terms.select(
        "index_name", "field", *_point(F.lit(0), F.col("term"), F.lit(1)), F.lit(0).cast("long").alias("change"), F.lit(0).alias("cut")
    )
    ordered = scratch_table(cuts.union(words).repartitionByRange(*place).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("cut").alias("cuts"), F.sum("change").alias("changes"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("cuts"),
        F.coalesce(F.sum("changes").over(before), F.lit(0)).alias("changes"),
    )
    up_to = Window.partitionBy("part").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ordered.join(F.broadcast(offsets), "part").select(
        *place,
        "cut",
        (F.col("cuts") + F.sum("cut").over(up_to)).alias("segment"),
        (F.col("changes") + F.sum("change").over(up_to)).alias("open"),
    )
    return scratch_table(numbered.where((F.col("cut") == 1) | (F.col("open") > 0)))


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def cover(first: Column, last: Column) -> Column:
    """The fewest aligned blocks of segments that make up [first, last], as (level, node).

    On each level at most the outermost block on either side is needed.
    """
    one = F.lit(1).cast("long")
    levels = F.sequence(F.lit(0), F.length(F.bin(last + 1)).cast("int"))

    def blocks(h: Column) -> Column:
        left = _shift("shiftright", first + _shift("shiftleft", one, h) - 1, h)
        right = _shift("shiftright", last + 1, h)
        some = left < right
        odd = lambda x: x.bitwiseAND(one) == 1
        block = lambda n: F.struct(h.cast("int").alias("level"), n.alias("node"))
        return F.array_compact(
            F.array(F.when(some & odd(left), block(left)), F.when(some & odd(right), block(right - 1)))
        )

    return F.flatten(F.transform(levels, blocks))


def range_nodes(ranges: DataFrame, marks: DataFrame) -> DataFrame:
    """``ranges`` with one row for each (level, node) that they are made up of."""
    cuts = marks.where(F.col("cut") == 1)
    found = ranges
    for suffix, name in (("_1", "first"), ("_2", "end")):
        ends = cuts.select(
            "index_name", "field", *(F.col(n).alias(n + suffix) for n in POINT), F.col("segment").alias(name)
        )
        found = found.join(ends, ["index_name", "field", *(n + suffix for n in POINT)])
    covered = found.select(*ranges.columns, F.inline(cover(F.col("first"), F.col("end") - 1)))
    return covered.drop(*(n + s for n in POINT for s in ("_1", "_2")))


def term_nodes(marks: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(index_name, field, term, nodes): the (level, node) of ranges that a term lies in, one row for each term."""
    terms = marks.where(F.col("cut") == 0).select("index_name", "field", F.col("bound").alias("term"), "segment")
    used = nodes.select(*NODE).distinct()
    inside = with_nodes(terms, levels).join(used, list(NODE), "left_semi")
    return inside.groupBy(*TERM_KEY).agg(F.collect_list(F.struct(*NODE)).alias("nodes"))


def with_nodes(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` with one row for each node, up to level ``levels``, that holds their segment."""
    climbed = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return climbed.withColumn("node", _shift("shiftright", F.col("segment"), F.col("level"))).drop("segment")


def range_matches(ranges: DataFrame, corpus, join, columns: Sequence[str]) -> DataFrame:
    """(qid, keys, *columns, field) of ``ranges``, once for each document and field with a term inside.

    However many ranges there are, the corpus is read for postings once, and
    for its distinct terms once if the bounds are many.  ``join(rows, table, on)``
    joins rows of documents with a table of measured size.
    """
    keys = list(corpus.keys)
    placed = with_points(ranges)
    inside = scan_filter(placed)
    fields = sorted({r["field"] for r in placed.select("field").distinct().collect()})
    postings = corpus.postings_between(inside, fields).select("index_name", *keys, "field", "term")
    place = ["index_name", "field", *POINT]
    bounds = _ends(placed).select(*place).distinct()
    few = bounds.limit(LITERAL_BOUNDS + 1).collect()
    if len(few) <= LITERAL_BOUNDS:
        segment, number = segment_of(few)
        schema = bounds.withColumns({"segment": F.lit(0).cast("long"), "cut": F.lit(1)}).schema
        marks = ranges.sparkSession.createDataFrame([(*row, n, 1) for row, n in zip(few, number)], schema)
    else:
        marks = sorted_marks(placed, corpus.terms_between(inside, fields))
    nodes = scratch_table(range_nodes(placed, marks))
    levels = nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    at = ["index_name", "field", *NODE]
    partitions = getattr(corpus, "partitions", None)
    if len(few) <= LITERAL_BOUNDS:
        parts = postings.select("index_name", *keys, "field", segment.alias("segment"))
        parts = repartitioned(parts, partitions, *keys).distinct()
        met = with_nodes(parts, levels)
    else:
        words = scratch_table(term_nodes(marks, nodes, levels))
        # By document from here on: nothing that follows needs another exchange.
        met = join(postings, words, list(TERM_KEY)).select("index_name", *keys, "field", F.inline("nodes"))
        met = repartitioned(met, partitions, *keys).distinct()
    found = join(met, nodes.select(*at, "qid", *columns), at)
    return found.select("qid", *keys, *columns, "field").distinct()
