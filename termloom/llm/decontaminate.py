"""Benchmark decontamination by greedy string tiling.

A text and a test item that share a seed of ``LEAST_MATCH`` words are compared:
the longest match of unmarked words is marked in both, again and again, with
running Karp-Rabin hashes to find it.  What the tiles cover of the item counts,
in whatever order they stand in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import IDENTITY, document_keys, slices, written
from termloom.llm.shingles import PUNCTUATION, mix, word_hashes

#: Words that a tile has at least; items with fewer words need a tile of their length.
LEAST_MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Words of test items that one pass over the texts looks for.
PASS_WORDS = 1_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _free_runs(marked: np.ndarray) -> np.ndarray:
    """How many unmarked words follow from each place on."""
    at = np.arange(len(marked))
    stop = np.where(marked, at, len(marked))
    return np.minimum.accumulate(stop[::-1])[::-1] - at


class _Windows:
    """Karp-Rabin hashes of all windows of one size, for any size."""

    def __init__(self, words: np.ndarray):
        self.powers = np.full(len(words) + 1, _BASE, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[: len(words)], dtype=np.uint64)])
        inverse = np.full(len(words), pow(_BASE, -1, 2**64), np.uint64)
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), inverse]))

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def _matching(free: list[np.ndarray], windows: tuple[_Windows, _Windows], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of the unmarked windows of ``size`` words that both sequences hold."""
    starts = [np.flatnonzero(f >= size) for f in free]
    hashes = [w.at(s, size) for w, s in zip(windows, starts)]
    both = [np.isin(hashes[0], hashes[1]), np.isin(hashes[1], hashes[0])]
    return [(s[b], h[b]) for s, h, b in zip(starts, hashes, both)]


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in item, place in text, words), longest first.

    Equal lengths are taken by place in the item, then in the text.  The longest
    length is found by bisection, as shorter windows match wherever longer ones
    do.  Equal windows meet as two lists of places, never as all their pairs, so
    work and memory stay linear in the words for each length, and the lengths of
    an item of n words are fewer than the root of 2n.
    """
    marked = [np.zeros(len(item), bool), ~np.isin(text, item)]
    windows = _Windows(item), _Windows(text)
    tiles: list[tuple[int, int, int]] = []
    most = len(item)
    while True:
        free = [_free_runs(m) for m in marked]
        low, high = least - 1, min(most, *(int(f.max()) if len(f) else 0 for f in free))
        found = None
        while low < high:
            size = (low + high + 1) // 2
            met = _matching(free, windows, size)
            if len(met[0][0]):
                low, found = size, met
            else:
                high = size - 1
        if found is None:
            return tiles
        tiles += _mark(item, text, marked, found, low)
        # What was not taken now overlaps a tile: no match of this length is left.
        most = low - 1


def _mark(item, text, marked, found, size: int) -> list[tuple[int, int, int]]:
    """Take and mark the matches of ``size`` words, the longest there are.

    Tiles of this pass all have one length, so one that overlaps a window covers
    an end of it; and a place that is covered once stays covered, so each list of
    places is walked once, apart from windows that are equal in hash alone.
    """
    (places, hashes), (theirs, their_hashes) = found
    order = np.argsort(their_hashes, kind="stable")
    theirs, their_hashes = theirs[order].tolist(), their_hashes[order]
    groups = np.searchsorted(their_hashes, hashes, "left").tolist()
    ends = np.searchsorted(their_hashes, hashes, "right").tolist()
    walked: dict[int, int] = {}
    out = []
    for i, group, end in zip(places.tolist(), groups, ends):
        if marked[0][i] or marked[0][i + size - 1]:
            continue
        at = walked.get(group, group)
        while at < end and (marked[1][theirs[at]] or marked[1][theirs[at] + size - 1]):
            at += 1
        walked[group] = at
        while at < end:  # checks the words themselves, hash or not
            j = theirs[at]
            if not (marked[1][j] or marked[1][j + size - 1]) and np.array_equal(item[i : i + size], text[j : j + size]):
                marked[0][i : i + size] = marked[1][j : j + size] = True
                out.append((i, j, size))
                break
            at += 1
    return out


class Tests:
    """Some test items, and the seeds that find them."""

    def __init__(self, ids: list, words: list[np.ndarray], least: int = LEAST_MATCH):
        self.ids, self.words, self.least = ids, words, least
        seeds, owners = [], []
        self.short: dict[int, list[int]] = {}
        for number, own in enumerate(words):
            if len(own) < least:
                if len(own):
                    self.short.setdefault(len(own), []).append(number)
            else:
                found = np.unique(seed_hashes(own, least))
                seeds.append(found)
                owners.append(np.full(len(found), number))
        seeds, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, owners))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], owners[order]

    def candidates(self, text: np.ndarray) -> list[int]:
        """Items that share a seed with the text."""
        out: set[int] = set()
        if len(self.seeds) and len(text) >= self.least:
            seeds = seed_hashes(text, self.least)
            place = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
            hits = np.unique(seeds[self.seeds[place] == seeds])
            for low, high in zip(np.searchsorted(self.seeds, hits), np.searchsorted(self.seeds, hits, "right")):
                out.update(self.owners[low:high].tolist())
        for size, numbers in self.short.items():
            if len(text) >= size:
                there = seed_hashes(text, size)
                out.update(n for n in numbers if seed_hashes(self.words[n], size)[0] in there)
        return sorted(out)

    def covered(self, text: np.ndarray) -> Iterator[tuple]:
        """(id, covered words, words) of each candidate."""
        for number in self.candidates(text):
            own = self.words[number]
            yield self.ids[number], sum(t[2] for t in tile(own, text, min(self.least, len(own)))), len(own)


def seed_hashes(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        out = mix(out + words[i : i + len(out)] + _U(i))
    return out


#: The columns that tell the texts of test items apart.
ITEM_TEXT = ["item_hash", "item_hash2"]
#: Shares that a pass is dealt from, so that passes come out about equal.
SHARES = 16
_HIT = "key long, text_hash long, text_hash2 long, item_hash long, item_hash2 long, covered long, words long"


def _passes(texts: DataFrame) -> list[list[int]]:
    """Shares of the item texts, by hash, packed into passes of about ``PASS_WORDS`` words."""
    room = PASS_WORDS * 4
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shares = max(1, -(-total // room)) * SHARES
    share = F.pmod("item_hash", F.lit(shares)).alias("share")
    sizes = texts.groupBy(share).agg(F.sum(F.length("text")).alias("size")).orderBy("share").collect()
    out: list[list[int]] = []
    left = 0
    for row in sizes:
        if not out or row["size"] > left:
            out.append([])
            left = room
        out[-1].append(row["share"])
        left -= row["size"]
    return [[shares, *own] for own in out]


def tiled_texts(docs: DataFrame, texts: DataFrame, least: int = LEAST_MATCH) -> DataFrame:
    """(key, text_hash, text_hash2, item_hash, item_hash2, covered, words) of each text and item that share a seed.

    ``texts`` has (item_hash, item_hash2, text), each text once.  They are
    searched in passes of about ``PASS_WORDS`` words, or of one longer text;
    each pass reads all documents once.
    """
    spark = docs.sparkSession
    found = None
    for shares, *own in _passes(texts) or [[1, 0]]:
        part = texts.where(F.pmod("item_hash", F.lit(shares)).isin(own)).toArrow().to_pydict()
        words, counts = word_hashes([t.encode() for t in part["text"]], PUNCTUATION)
        cut = np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
        shared = spark.sparkContext.broadcast((list(zip(*(part[c] for c in ITEM_TEXT))), cut))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = Tests(*shared.value, least)
            for batch in batches:
                for some in slices(batch, "text"):
                    words, counts = word_hashes([t.encode() for t in some.column("text").to_pylist()], PUNCTUATION)
                    ends = np.cumsum(counts)
                    out = {n.split()[0]: [] for n in _HIT.split(", ")}
                    keys = zip(*(some.column(c).to_pylist() for c in IDENTITY), ends - counts, ends)
                    for *own, start, end in keys:
                        for item, covered, size in tests.covered(words[start:end]):
                            for n, v in zip(out, (*own, *item, covered, size)):
                                out[n].append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

        hits = docs.select(*IDENTITY, "text").mapInArrow(run, _HIT)
        found = hits if found is None else found.union(hits)
    return found


def tiled_items(docs: DataFrame, items: DataFrame, least: int = LEAST_MATCH) -> DataFrame:
    """(key, text_hash, text_hash2, item_id, covered, words) of each text and item that share a seed.

    ``docs`` as by :func:`document_keys`.  Items (item_id, text) that repeat a
    text are searched for once, and their ids joined to what is found.
    """
    text = F.coalesce("text", F.lit(""))
    named = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.xxhash64(text).alias("item_hash"),
        # What comes first seeds the hash of what follows.
        F.xxhash64(F.lit(1), text).alias("item_hash2"),
        text.alias("text"),
    )
    texts = written(named.groupBy(*ITEM_TEXT).agg(F.first("text").alias("text")))
    ids = named.select(*ITEM_TEXT, "item_id").distinct()
    found = tiled_texts(docs, texts, least)
    return found.join(ids, ITEM_TEXT).select(*IDENTITY, "item_id", "covered", "words")


def contamination(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, least: int = LEAST_MATCH) -> DataFrame:
    """(doc_id, key, text_hash, text_hash2, contaminated, n_items, items, max_coverage) of each row of ``docs``.

    ``items`` lists the ids (ascending) of test items of whose words tiles cover
    ``coverage`` or more, ``max_coverage`` is the largest share of any item that
    shares a seed (0 without one).  An item without an id contaminates as others
    do, but is neither listed nor counted in ``n_items``.  Null and empty texts and items match
    nothing; rows that repeat both doc_id and text get the same result.
    """
    docs = document_keys(docs)
    share = F.col("covered") / F.col("words")
    per_text = (
        tiled_items(docs, items, least)
        .select(*IDENTITY, "item_id", share.alias("share"))
        .groupBy(*IDENTITY)
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("share") >= coverage, F.col("item_id")))).alias("items"),
            F.max("share").alias("max_coverage"),
        )
    )
    rows = docs.select("doc_id", *IDENTITY).join(per_text, IDENTITY, "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    return rows.select(
        "doc_id",
        *IDENTITY,
        F.coalesce(F.col("max_coverage") >= coverage, F.lit(False)).alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"),
    )
