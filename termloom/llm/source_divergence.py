"""How the sources of each language differ in their use of words.

Term counts of every (lang, source) group are compared with those of each
other group of the language by three-dimensional cube partitioning: a task
owns a cell of (group block, group block, term block), to which the slices of
the counts that it needs are copied; it computes partial divergences of its
pairs over its terms, and these are summed along the term axis.  All
arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import slices, small, written

#: Documents of a language that hold a term at least.
LEAST_DOCUMENTS = 3
#: Scale of the shares: p = 1 + floor(SCALE * (count + 1) / (N + V)).
SCALE = 1_000_000_000
#: Terms of a group that are reported at most.
MOST_TERMS = 200
#: Groups and terms on the sides of a cell, on average; a slice has at most their product.
GROUP_BLOCK = 32
TERM_BLOCK = 8_192
#: Counts that a task holds before it passes them on.
HELD = 300_000
#: Groups that are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Counts up to this can be multiplied by SCALE as long integers.
_LONG = 9_000_000_000

#: Bytes of a term are A-Z, a-z and all that are not ASCII; A-Z become a-z.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in each group, and documents that hold the term.

    Null text, lang and source are empty.  Tasks add up what they read before
    anything is shuffled, so frequent terms of a large group send few rows.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def rows(occurrences: dict, holders: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            held = holders[lang, source]
            columns = [
                pa.array([lang] * len(counts), pa.string()),
                pa.array([source] * len(counts), pa.string()),
                pa.array(list(counts), pa.binary()).cast(pa.string()),
                pa.array(list(counts.values()), pa.int64()),
                pa.array([held[t] for t in counts], pa.int64()),
            ]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, holders = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            for some in slices(batch, "text"):
                texts = some.column("text").cast(pa.binary()).to_pylist()
                for lang, source, text in zip(some.column("lang").to_pylist(), some.column("source").to_pylist(), texts):
                    terms = text.translate(_LETTERS).split()
                    occurrences[lang, source].update(terms)
                    holders[lang, source].update(set(terms))
                if sum(map(len, occurrences.values())) >= HELD:
                    yield from rows(occurrences, holders)
                    occurrences.clear()
                    holders.clear()
        yield from rows(occurrences, holders)

    some = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = some.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly."""
    large = F.call_function("div", F.lit(SCALE).cast("decimal(19,0)") * (n + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))
    short = F.call_function("div", F.lit(SCALE) * (n + 1), total)
    return F.when(n < _LONG, short).otherwise(large).cast("long") + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Slice:
    """Groups of one block, and their shares of the terms of one block, by group."""

    def __init__(self, source: np.ndarray, code: np.ndarray, p: np.ndarray, vocabulary: np.ndarray) -> None:
        group = code < 0
        order = np.argsort(source[group])
        self.sources = source[group][order]
        self.absent = p[group][order]
        self.vocabulary = vocabulary[group][order]
        owner = np.searchsorted(self.sources, source[~group])
        by_owner = np.argsort(owner, kind="stable")
        self.owner, self.term, self.p = owner[by_owner], code[~group][by_owner], p[~group][by_owner]
        self.ends = np.searchsorted(self.owner, np.arange(len(self.sources) + 1))


def _partial(left: _Slice, right: _Slice, terms: int, whole: bool) -> np.ndarray:
    """Divergence of each group of ``left`` from each of ``right`` over the cell's terms.

    Against that of terms which both lack, which counts for all terms of the
    language at once, in the cell that is marked ``whole``.
    """
    out = np.zeros((len(left.sources), len(right.sources)), np.int64)
    dense = np.repeat(right.absent[:, None], terms, axis=1)
    dense[right.owner, right.term] = right.p
    some = np.flatnonzero(right.ends[1:] > right.ends[:-1])
    for g, absent in enumerate(left.absent):
        base = _parts(absent, right.absent)
        if whole:
            out[g] = base * left.vocabulary[g]
        if len(some):
            more = _parts(absent, right.p) - base[right.owner]
            out[g, some] += np.add.reduceat(more, right.ends[some])
        own = slice(left.ends[g], left.ends[g + 1])
        q = dense[:, left.term[own]]
        out[g] += (_parts(left.p[own], q) - _parts(absent, q)).sum(axis=1)
    return out


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    lang, a, b, t = (k.as_py() for k in key)
    number = rows.column("source").combine_chunks().dictionary_encode()
    named = number.dictionary.to_pylist()
    source = number.indices.to_numpy()
    encoded = rows.column("term").combine_chunks().dictionary_encode()
    code = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    p, vocabulary = (rows.column(c).to_numpy() for c in ("p", "vocabulary"))
    block = rows.column("block").to_numpy()
    left, right = (_Slice(*(x[block == k] for x in (source, code, p, vocabulary))) for k in (a, b))
    sources, items, values = [], [], []
    for one, other in [(left, right)] + ([(right, left)] if a != b else []):
        found = _partial(one, other, len(encoded.dictionary), t == 0)
        apart = one.sources[:, None] != other.sources[None, :]
        sources.append(np.broadcast_to(one.sources[:, None], found.shape)[apart])
        items.append(np.broadcast_to(other.sources[None, :], found.shape)[apart])
        values.append(found[apart])
    sources, items, values = (np.concatenate(x) for x in (sources, items, values))
    names = pa.array(named, pa.string())
    return pa.table(
        {
            "lang": pa.array([lang] * len(values), pa.string()),
            "source": names.take(pa.array(sources)),
            "item": names.take(pa.array(items)),
            "value": pa.array(values, pa.int64()),
        }
    )


def pair_divergence(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of different sources of a language, by cells.

    ``groups`` are (lang, source, total, vocabulary, group_blocks, term_blocks,
    block), ``counts`` (lang, source, term, p, group_blocks, term_blocks, block).
    A block's slice is copied to the cells of its block with every other one.
    """
    cell_terms = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))
    absent = share(F.lit(0).cast("long"), F.greatest(F.col("total") + F.col("vocabulary"), F.lit(1)))
    columns = ["lang", "source", "block", "group_blocks", "t", "term", "p", "vocabulary"]
    rows = counts.withColumn("t", cell_terms).withColumn("vocabulary", F.lit(0).cast("long")).select(columns)
    heads = groups.withColumn("t", every).withColumn("term", F.lit(None).cast("string")).withColumn("p", absent)
    copies = rows.union(heads.select(columns)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1))
    )
    cells = copies.select(
        "lang",
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        "t",
        *("source", "block", "term", "p", "vocabulary"),
    )
    partial = cells.groupBy("lang", "a", "b", "t").applyInArrow(_cell, "lang string, source string, item string, value long")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of ``docs`` (lang, source, text).

    Part ``pair`` has one row for each other source of the language, with the
    divergence of the group from it, summed over the kept terms; a language
    without kept terms gives 0.  Part ``term`` has the ``most_terms`` kept terms
    that the group uses most beyond the language's share.  Ranks are by value
    descending, then item.  Null text, lang and source are empty; each row is a
    document of its own, also where rows repeat; other columns are ignored.
    """
    counts = written(term_counts(docs))
    together = Window.partitionBy("lang", "term")
    kept = written(
        counts.select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("docs").over(together).alias("holders"),
            F.sum("n").over(together).alias("lang_n"),
            (F.row_number().over(together.orderBy("source")) == 1).cast("long").alias("first"),
        )
        .where(F.col("holders") >= LEAST_DOCUMENTS)
        .drop("holders")
    )
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("firsts"))
    joined = written(every.join(totals, ["lang", "source"], "left").na.fill(0, ["n", "firsts"]))
    langs = joined.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum("firsts").alias("vocabulary"), F.count("*").alias("sources")
    )
    blocks = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("long")
    sized = joined.join(langs, "lang").withColumns(
        {"group_blocks": blocks("sources", GROUP_BLOCK), "term_blocks": blocks("vocabulary", TERM_BLOCK)}
    )
    groups = small(
        sized.select(
            "lang",
            "source",
            F.col("n").alias("total"),
            *("lang_total", "vocabulary", "group_blocks", "term_blocks"),
            F.pmod(F.xxhash64("source"), F.col("group_blocks")).alias("block"),
        ),
        BROADCAST_GROUPS,
    )
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total") + F.col("vocabulary")))
    pairs = pair_divergence(groups, shares)
    q = share(F.col("lang_n"), F.col("lang_total") + F.col("vocabulary"))
    terms = (
        shares.withColumn("q", q)
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).withColumn("part", F.lit(name))
        for part, name, most in ((pairs, "pair", 2**31 - 1), (terms, "term", most_terms))
    ]
    return ranked[0].union(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
