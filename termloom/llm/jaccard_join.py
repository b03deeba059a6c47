"""Exact n-gram Jaccard join by T-occurrence search with DivideSkip.

Documents with equal shingle sets form one class.  Classes that cannot reach
the threshold with any other are dropped by a prefix filter; the rest are split
into families that share a prefix shingle, and each family is searched through
inverted lists: the short lists are heap-merged, the long ones only probed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import IDENTITY, components, document_keys, slices, small, written
from termloom.llm.shingles import shingle_sets

THRESHOLD = 75
#: Shingles that a task gathers before it sends them on, grouped by hash range.
FLUSH = 500_000
#: Shingles that one search task holds at most; larger families are searched in blocks.
BLOCK = 1_000_000
#: The filter's prefix is longer than the least one by this fraction of the set.
SPARE = 10
#: Frequencies count up to here; a shingle this frequent in one task needs no exchange.
FREQUENT = 500
#: Classes whose keys are broadcast to read their texts; more are joined by a shuffle.
BROADCAST_CLASSES = 500_000
#: DivideSkip's cost ratio between merging an entry and probing a long list.
MU = 0.0085
_U = np.uint64


def least_overlap(size):
    """Shingles that a set of ``size`` must share with any partner."""
    return -(-THRESHOLD * size // 100)


def filter_prefix(size):
    """Length of the prefix, in hash order, that the filter looks at.

    Partners share ``size // SPARE + 1`` of its entries at least, for the smaller
    of their sizes, and no partner is smaller than ``least_overlap(size)``.
    """
    return np.minimum(size, size - least_overlap(size) + size // SPARE + 1)


def _ranges(flush_h: np.ndarray, ranges: int) -> np.ndarray:
    return (flush_h >> _U(40)).astype(np.int64) * ranges >> 24


def _by_range(h: np.ndarray, ids: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``h`` (ascending) with its ids, cut at the borders of the hash ranges."""
    borders = np.searchsorted(_ranges(h, ranges), np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(borders)):
        cut = slice(borders[r], borders[r + 1])
        yield int(r), h[cut].tobytes(), ids[cut].tobytes()


def _shared(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For h ascending: whether another document has the same value. docs: -1 stands for several."""
    run = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    lengths = np.diff(np.r_[run, len(h)])
    least = np.minimum.reduceat(docs, run)
    most = np.maximum.reduceat(docs, run)
    return np.repeat((least != most) | (least == -1), lengths)


def _tally(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(docs, return_counts=True)


_FILTER = "part int, h binary, docs binary, doc_id long, text_hash long, text_hash2 long, size long, sig1 long, sig2 long, sig long, shared long"


def _filter_rows(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows to exchange: prefixes by hash range, counts known already, and one row a document."""
    names = [c.split()[0] for c in _FILTER.split(", ")]
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, types)], names
        )

    met: set[tuple[int, int]] = set()
    hashes, owners, waiting, turn = [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if not waiting:
            return
        h, docs = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        h, docs = h[order], docs[order]
        shared = _shared(h, docs)
        # Shared within this task: counted here, and one entry tells the others.
        ids, counts = _tally(docs[shared])
        if len(ids):
            yield rows(part=(np.arange(len(ids)) + int(h[0] % _U(ranges))) % ranges, sig=ids, shared=counts)
        first = np.r_[True, h[1:] != h[:-1]]
        keep = ~shared | first
        h, docs = h[keep], np.where(shared, -1, docs)[keep]
        parts = list(_by_range(h, docs, ranges))
        for at in range(0, len(parts), 64):
            part, hs, ds = zip(*parts[at : at + 64])
            yield rows(part=part, h=hs, docs=ds)
        hashes.clear()
        owners.clear()
        waiting = 0

    for batch in batches:
        for some in slices(batch, "text"):
            sets = shingle_sets([t.encode() for t in some.column("text").to_pylist()])
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            sig = [(xxhash.xxh64_intdigest(s.data), xxhash.xxh64_intdigest(s.data, 1)) for s in sets]
            sig1, sig2 = np.array(sig, np.uint64).view(np.int64).T
            # Dealt in turn: copies have one signature, and may be very many.
            turn += len(sets)
            yield rows(part=np.arange(turn - len(sets), turn) % ranges, doc_id=some.column("doc_id"), text_hash=some.column("text_hash"), text_hash2=some.column("text_hash2"), size=size, sig1=sig1, sig2=sig2)
            for s, own, pair, cut in zip(sets, sig1, sig, filter_prefix(size)):
                if len(s) and pair not in met:
                    met.add(pair)
                    hashes.append(s[:cut])
                    owners.append(np.full(cut, own))
                    waiting += cut
            if waiting >= FLUSH:
                yield from flush()
                met.clear()
    yield from flush()


def _filter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: how many prefix entries each document shares. Other rows pass."""
    hashes, owners, schema = [], [], None
    for batch in batches:
        schema = schema or batch.schema.remove(2).remove(1).remove(0)
        blobs = batch.filter(batch.column("h").is_valid())
        hashes += [np.frombuffer(x, np.uint64) for x in blobs.column("h").to_pylist()]
        owners += [np.frombuffer(x, np.int64) for x in blobs.column("docs").to_pylist()]
        rest = batch.filter(pa.compute.is_null(batch.column("h")))
        yield pa.RecordBatch.from_arrays([rest.column(f.name) for f in schema], schema=schema)
    if hashes:
        h, docs = np.concatenate(hashes), np.concatenate(owners)
        hashes, owners = [], []
        order = np.argsort(h)
        h, docs = h[order], docs[order]
        docs = docs[_shared(h, docs)]
        ids, counts = _tally(docs[docs != -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids) if f.name == "sig" else pa.array(counts) if f.name == "shared" else pa.nulls(len(ids), f.type) for f in schema],
            schema=schema,
        )


def document_sets(docs: DataFrame, ranges: int) -> DataFrame:
    """One row a document (doc_id, text_hash, text_hash2, size, sig1, sig2), and rows (sig, shared) for the filter.

    ``sig1`` and ``sig2`` are two hashes of the whole shingle set.
    """
    rows = docs.select("doc_id", "text_hash", "text_hash2", "text").mapInArrow(lambda b: _filter_rows(b, ranges), _FILTER)
    kept = _FILTER.partition("docs binary, ")[2]
    return written(rows.repartition(ranges, "part").mapInArrow(_filter_counts, kept))


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(sig1, sig2, text) of each document in ``reps``: one row, and one more for each repeat of its row."""
    wanted = small(reps.select(*IDENTITY, "sig1", "sig2"), BROADCAST_CLASSES)
    return docs.select(*IDENTITY, "text").join(wanted, IDENTITY).select("sig1", "sig2", "text")


def _candidate_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls, size, sig1, sig2, shingles) of each class in ``reps``; cls is a number given once.

    A class whose row is repeated may come more than once; its copies then link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for some in slices(batch, "text"):
                sets = shingle_sets([t.encode() for t in some.column("text").to_pylist()])
                own = [(xxhash.xxh64_intdigest(s.data), xxhash.xxh64_intdigest(s.data, 1)) for s in sets]
                wanted = zip(*(some.column(c).to_numpy().view("u8").tolist() for c in ("sig1", "sig2")))
                keep = []
                for i, (pair, other) in enumerate(zip(own, wanted)):
                    if pair == other and pair not in met:
                        met.add(pair)
                        keep.append(i)
                signs = np.array([own[i] for i in keep], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"size": pa.array([len(sets[i]) for i in keep], pa.int64()), "sig1": signs[:, 0], "sig2": signs[:, 1], "shingles": pa.array([sets[i].tobytes() for i in keep], pa.binary())}
                )

    sets = _texts_of(docs, reps).mapInArrow(run, "size long, sig1 long, sig2 long, shingles binary")
    return written(sets.select(F.monotonically_increasing_id().alias("cls"), "size", "sig1", "sig2", "shingles"))


_RARITY = np.dtype([("cls", "i8"), ("df", "i4"), ("h", "u8")])


def _batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in schema.items()], list(schema))


def _to_classes(cls: np.ndarray, h: np.ndarray, df: np.ndarray, ranges: int) -> tuple[np.ndarray, list[bytes]]:
    """Entries packed by the task that their class goes to."""
    out = np.empty(len(h), _RARITY)
    out["cls"], out["h"], out["df"] = cls, h, df
    home = cls % ranges
    order = np.argsort(home, kind="stable")
    borders = np.searchsorted(home[order], np.arange(ranges + 1))
    out = out[order]
    used = np.flatnonzero(np.diff(borders))
    return used, [out[borders[r] : borders[r + 1]].tobytes() for r in used]


def shared_shingles(sets: DataFrame, ranges: int) -> DataFrame:
    """(home, cls, size, rare): rows that together hold each class's size, and its shingles that others have too.

    ``rare`` packs (cls, df, h) of the classes of one home; df is in how many
    classes the shingle is, up to ``FREQUENT``.
    """
    sent = {"part": pa.int32(), "h": pa.binary(), "ids": pa.binary(), "home": pa.int32(), "cls": pa.int64(), "size": pa.int64(), "rare": pa.binary()}
    schema = "part int, h binary, ids binary, home int, cls long, size long, rare binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, waiting = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting:
                h, ids = np.concatenate(hashes), np.concatenate(owners)
                order = np.argsort(h)
                h, ids = h[order], ids[order]
                first = np.r_[True, h[1:] != h[:-1]]
                lengths = np.diff(np.r_[np.flatnonzero(first), len(h)])
                often = np.repeat(lengths >= FREQUENT, lengths)
                if often.any():  # known without the others; a mark tells them
                    home, rare = _to_classes(ids[often], h[often], np.full(often.sum(), FREQUENT), ranges)
                    yield _batch(sent, part=home, home=home, rare=rare)
                    ids = np.where(often, -1, ids)
                keep = ~often | first
                part, hs, ds = zip(*_by_range(h[keep], ids[keep], ranges))
                yield _batch(sent, part=part, h=hs, ids=ds)
                hashes.clear()
                owners.clear()
                waiting = 0

        for batch in batches:
            cls = batch.column("cls").to_numpy()
            yield _batch(sent, part=cls % ranges, home=cls % ranges, cls=cls, size=batch.column("size").to_numpy())
            for own, s in zip(cls, batch.column("shingles").to_pylist()):
                hashes.append(np.frombuffer(s, np.uint64))
                owners.append(np.full(len(hashes[-1]), own))
                waiting += len(hashes[-1])
                if waiting >= FLUSH:
                    yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = dict(list(sent.items())[3:])
        hashes, owners = [], []
        for batch in batches:
            blobs = batch.filter(batch.column("h").is_valid())
            hashes += [np.frombuffer(x, np.uint64) for x in blobs.column("h").to_pylist()]
            owners += [np.frombuffer(x, np.int64) for x in blobs.column("ids").to_pylist()]
            rest = batch.filter(batch.column("home").is_valid())
            yield pa.RecordBatch.from_arrays([rest.column(c) for c in kept], list(kept))
        if hashes:
            h, ids = np.concatenate(hashes), np.concatenate(owners)
            hashes, owners = [], []
            order = np.argsort(h)
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            lengths = np.diff(np.r_[first, len(h)])
            df = np.minimum(np.add.reduceat(np.where(ids == -1, FREQUENT, 1), first), FREQUENT)
            df = np.repeat(df, lengths)
            out = (df > 1) & (ids != -1)
            home, rare = _to_classes(ids[out], h[out], df[out], ranges)
            yield _batch(kept, home=home, rare=rare)

    rows = sets.select("cls", "size", "shingles").mapInArrow(send, schema)
    return rows.repartition(ranges, "part").mapInArrow(meet, "home int, cls long, size long, rare binary")


def spanning(edges: np.ndarray) -> np.ndarray:
    """Edges (least, other) that join the same nodes as ``edges`` (pairs), one for each node but the least."""
    if not len(edges):
        return np.zeros((0, 2), np.int64)
    nodes, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        # The old label's node learns too, so whole trees move at once.
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[other]], nodes[other]], 1)


def _stars(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that join all documents of each value; and the least of each value."""
    order = np.lexsort((docs, h))
    h, docs = h[order], docs[order]
    first = np.r_[True, h[1:] != h[:-1]]
    least = np.repeat(docs[first], np.diff(np.r_[np.flatnonzero(first), len(h)]))
    return spanning(np.stack([least, docs], 1)[least != docs]), h[first], docs[first]


def family_edges(sets: DataFrame, ranges: int) -> DataFrame:
    """Edges (a, b) that join all classes which share a shingle of their rarest n - T + 1.

    Linked classes always share one.  A class that shares fewer than T
    shingles with all others together has no partner and joins nobody.
    """
    sent = {"part": pa.int32(), "h": pa.binary(), "ids": pa.binary(), "a": pa.int64(), "b": pa.int64()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, int] = {}
        blobs: list[bytes] = []
        for batch in batches:
            known = batch.filter(batch.column("cls").is_valid())
            sizes.update(zip(known.column("cls").to_pylist(), known.column("size").to_pylist()))
            blobs += batch.column("rare").drop_null().to_pylist()
        rare = np.frombuffer(b"".join(blobs), _RARITY)
        blobs = []
        rare = rare[np.argsort(rare["cls"], kind="stable")]
        borders = np.flatnonzero(np.r_[True, rare["cls"][1:] != rare["cls"][:-1], True]) if len(rare) else [0]
        hashes, owners, waiting = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting:
                edges, h, ids = _stars(np.concatenate(hashes), np.concatenate(owners))
                if len(edges):
                    yield _batch(sent, part=edges[:, 0] % ranges, a=edges[:, 0], b=edges[:, 1])
                part, hs, ds = zip(*_by_range(h, ids, ranges))
                yield _batch(sent, part=part, h=hs, ids=ds)
                hashes.clear()
                owners.clear()
                waiting = 0

        for start, end in zip(borders[:-1], borders[1:]):
            entries, cls = rare[start:end], int(rare["cls"][start])
            size = sizes[cls]
            if len(entries) < least_overlap(size):
                continue
            alone = size - len(entries)
            order = np.lexsort((entries["h"], entries["df"]))[: size - least_overlap(size) + 1 - alone]
            hashes.append(entries["h"][order])
            owners.append(np.full(len(order), cls))
            waiting += len(order)
            if waiting >= FLUSH:
                yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners = [], []
        for batch in batches:
            blobs = batch.filter(batch.column("h").is_valid())
            hashes += [np.frombuffer(x, np.uint64) for x in blobs.column("h").to_pylist()]
            owners += [np.frombuffer(x, np.int64) for x in blobs.column("ids").to_pylist()]
            rest = batch.filter(batch.column("a").is_valid())
            yield pa.RecordBatch.from_arrays([rest.column("a"), rest.column("b")], ["a", "b"])
        if hashes:
            edges, _, _ = _stars(np.concatenate(hashes), np.concatenate(owners))
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    shared = shared_shingles(sets, ranges).repartition(ranges, "home").mapInArrow(send, "part int, h binary, ids binary, a long, b long")
    return shared.repartition(ranges, "part").mapInArrow(meet, "a long, b long")


class InvertedLists:
    """Inverted lists of some documents, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(h, kind="stable")
        self.keys, first, counts = np.unique(h[order], return_index=True, return_counts=True)
        self.lists = owner[order]
        self.first, self.counts = first, counts

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents within the threshold of ``query``, and their overlaps."""
        at = np.searchsorted(self.keys, query)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == query] if len(self.keys) else at[:0]
        need = least_overlap(len(query))
        if len(at) < max(1, need):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = at[np.argsort(self.counts[at], kind="stable")]
        long = min(need - 1, int(need / (MU * np.log2(self.counts[at[-1]] + 1) + 1)))
        short, probed = at[: len(at) - long], at[len(at) - long :]
        merged = heapq.merge(*(self.lists[self.first[i] : self.first[i] + self.counts[i]].tolist() for i in short))
        found = [(doc, n) for doc, run in groupby(merged) if (n := sum(1 for _ in run)) >= need - long]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, overlap = np.array(found, np.int64).T
        for i in probed:
            inverted = self.lists[self.first[i] : self.first[i] + self.counts[i]]
            place = np.minimum(np.searchsorted(inverted, docs), len(inverted) - 1)
            overlap += inverted[place] == docs
        close = 100 * overlap >= THRESHOLD * (len(query) + self.sizes[docs] - overlap)
        return docs[close], overlap[close]


def spanning_links(ids: np.ndarray, families: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Edges that join the given documents just as all their links would.

    Leaders are searched first and take what they reach.  Then every document
    that a leader took is searched too, but for the largest group of a family:
    its links to others are found from their side.
    """
    lists = InvertedLists(sets)
    leader = np.full(len(ids), -1, np.int64)
    links: list[tuple[int, int]] = []
    for x in range(len(ids)):
        if leader[x] < 0:
            leader[x] = x
            near, _ = lists.search(sets[x])
            links += [(int(ids[x]), int(ids[y])) for y in near if y != x]
            leader[near[leader[near] < 0]] = x
    groups = pd.DataFrame({"family": families, "leader": leader}).groupby(["family", "leader"]).size()
    largest = set(groups.reset_index(name="n").sort_values(["n", "leader"]).groupby("family")["leader"].last())
    for x in range(len(ids)):
        if leader[x] != x and leader[x] not in largest:
            near, _ = lists.search(sets[x])
            links += [(int(ids[x]), int(ids[y])) for y in near if leader[y] != leader[x]]
    return spanning(np.array(links, np.int64))


def _sets_of(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in rows["shingles"]]


def _search_bin(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cls")
    links = spanning_links(rows["cls"].to_numpy(), rows["family"].to_numpy(), _sets_of(rows))
    return pd.DataFrame(links, columns=["a", "b"])


def _search_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Queries (left) against one block of a family."""
    lists = InvertedLists(_sets_of(right)) if len(left) and len(right) else None
    ids = right["cls"].to_numpy()
    links = [(int(c), int(ids[y])) for c, s in zip(left["cls"], _sets_of(left)) for y in lists.search(s)[0] if ids[y] != c] if lists else []
    return pd.DataFrame(spanning(np.array(links, np.int64)), columns=["a", "b"])


def class_links(sets: DataFrame, ranges: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between classes that span the components of all links."""
    families = components(family_edges(sets, ranges)).withColumnsRenamed({"node": "cls", "component": "family"})
    members = written(sets.join(families, "cls").select("cls", "family", "size", "shingles"))
    totals = members.groupBy("family").agg(F.sum("size").alias("total"))
    whole = members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, whole * 4 // block)
    home = totals.select("family", F.ceil(F.col("total") / block).cast("int").alias("blocks"))
    placed = members.join(home, "family").withColumn(
        "bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bins)))
    ).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    links = placed.groupBy("bin", F.when(F.col("blocks") > 1, F.col("family")).alias("large"), "block").applyInPandas(_search_bin, "a long, b long")
    links = written(links)
    if home.where("blocks > 1").isEmpty():
        return links
    # Families in several blocks: a few leaders first join the blocks' groups;
    # then all outside the family's largest group are searched in every block.
    split = written(placed.where("blocks > 1").select("cls", "family", "blocks", "block", "shingles"))

    def groups(found: DataFrame) -> DataFrame:
        named = components(found).withColumnRenamed("node", "cls")
        return split.join(named, "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    keys = ["family", "block", "chunk"]
    # Aliases, as both sides of the search come from the same table.
    fresh = [F.col(c).cast("long").alias(c) for c in (*keys, "cls")] + [F.col("shingles").alias("shingles")]

    def across(queries: DataFrame) -> DataFrame:
        chunks = F.ceil(F.count(F.lit(1)) / 500).cast("int")
        per = queries.groupBy("family").agg(chunks.alias("chunks"))
        asked = queries.join(per, "family").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = asked.select(*fresh)
        base = split.join(per, "family").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        base = base.select(*fresh)
        return written(asked.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(_search_block, "a long, b long"))

    sized = groups(links).groupBy("family", "block", "component").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("cls"))
    heads = sized.groupBy("family", "block").agg(F.max_by("cls", "n").alias("cls")).select("cls")
    links = written(links.union(across(split.join(heads, "cls", "left_semi"))))
    grouped = written(groups(links).select("cls", "family", "component"))
    sizes = grouped.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("component", "n").alias("main"))
    rest = grouped.join(main, "family").where(F.col("component") != F.col("main")).select("cls")
    return links.union(across(split.join(rest, "cls", "left_semi")))


def jaccard_components(docs: DataFrame, ranges: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, text_hash2, n_shingles, component_id, stays) of each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach; ``stays`` marks the
    document to keep of each component: that of least doc_id.  Null texts are
    empty; an empty document is linked with nothing, keeps its own id and
    stays.  Repeated rows are copies of each other, and stay or go together;
    null ids are never the smallest.
    """
    ranges = ranges or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = document_keys(docs)
    rows = document_sets(docs, ranges)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), key.alias("key"), "text_hash", "text_hash2")
    per_doc = rows.where("sig1 IS NOT NULL").select("doc_id", "text_hash", "text_hash2", "size", "sig1", "sig2", own.alias("own"))
    counts = rows.where("sig IS NOT NULL").groupBy(F.col("sig").alias("sig1")).agg(F.sum("shared").alias("shared"))
    classes = per_doc.where("size > 0").groupBy("sig1", "sig2", "size").agg(F.min("own").alias("least"))
    # What a partner of the least possible size shares within both prefixes.
    need = F.floor(F.ceil(F.col("size") * THRESHOLD / 100) / SPARE) + 1
    reps = classes.join(counts, "sig1").where(F.col("shared") >= need).select(*[F.col(f"least.{c}").alias(c) for c in IDENTITY], "sig1", "sig2")
    sets = _candidate_sets(docs, reps)
    grouped = components(class_links(sets, ranges, block)).withColumnRenamed("node", "cls")
    named = written(classes.join(sets.select("cls", "sig1", "sig2").join(grouped, "cls"), ["sig1", "sig2"]))
    roots = named.groupBy("component").agg(F.min("least").alias("root"))
    found = named.join(roots, "component").groupBy("sig1", "sig2").agg(F.min("root").alias("root"))
    # Written, so that the join below can split a class of very many copies.
    per_class = written(classes.join(found, ["sig1", "sig2"], "left").select("sig1", "sig2", F.coalesce("root", "least").alias("root")))
    empty = F.col("size") == 0
    root_id = F.when(~F.col("root.unnamed"), F.col("root.key"))
    return per_doc.join(per_class, ["sig1", "sig2"], "left").select(
        "doc_id",
        "text_hash",
        "text_hash2",
        F.col("size").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(root_id).alias("component_id"),
        (empty | (F.col("own") == F.col("root"))).alias("stays"),
    )
