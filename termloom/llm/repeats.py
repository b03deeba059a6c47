"""Repeated byte strings by threshold-bounded interval expansion.

Every string of ``LENGTH`` bytes belongs to one anchor: the least hash of its
byte runs of ``GRAM``.  Equal strings have equal anchors, so texts are cut into
overlapping segments, one an anchor, and segments meet by their anchor's hash.
Each group of segments gets a suffix array and its Burrows-Wheeler transform.
Intervals are extended backward, breadth first, which derives the common
prefixes of neighbouring suffixes by increasing value, up to ``LENGTH``: what
is still open then is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import document_keys, slices, written
from termloom.llm.shingles import mix

LENGTH = 200
GRAM = 32
#: Bytes of one block while anchors are looked for; blocks overlap.
SCAN = 1 << 18
#: Anchors that a task gathers before it sends them on, grouped by hash range.
FLUSH = 500_000
#: Bytes of segments that one task indexes at once.
BUCKET = 1_200_000
#: Bytes of segments under one anchor from which they are split further.
LARGE = 2_000_000
#: Segments of large groups whose places are broadcast to cut them out of their texts; more are shuffled.
BROADCAST_SEGMENTS = 200_000
#: String starts in the parts that a frequent anchor's segments are split into, in turn.
WIDTHS = (16, 1)
_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0xD6E8FEB86659FD93) + b
    x ^= x >> _U(32)
    return x * _U(0x9FB21C651E98DF25)


def _run_hashes(flat: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... ``longest`` bytes, by their start."""
    out, width = {1: _BYTE[flat]}, 1
    while width < longest:
        h = out[width]
        out[width * 2] = _pair(h[: len(h) - width], h[width:])
        if width not in (GRAM, 128):
            del out[width]
        width *= 2
    return out


def _least(x: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` numbers, by its start."""
    width = 1
    while width * 2 <= window:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = window - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(flat: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of one block: (start, strings, anchor hash, content hash, anchor's place).

    A segment holds ``strings`` consecutive starts of ``length`` bytes that
    share an anchor, the leftmost gram of least hash in each.
    """
    if len(flat) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    hashes = _run_hashes(flat, 128)
    grams = mix(hashes[gram])
    # The low bits carry the place: ties go to the left, as in every equal string.
    bits = _U(max(1, int(np.ceil(np.log2(len(flat) + 1)))))
    placed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(placed, length - gram + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    strings = np.diff(np.r_[first, len(at)])
    size = strings + length - 1
    h = hashes[128]
    content = _pair(_pair(h[first], h[first + (size - 128) // 2]), _pair(h[first + size - 128], size.astype(np.uint64)))
    # Least hashes are all small; mixed again they spread evenly.
    return first, strings, mix(grams[at[first]]), content, at[first]


def text_anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of a whole text, block by block; each string start is in one block."""
    flat = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(flat) - LENGTH + 1), SCAN):
        start, strings, anchor, content, _ = anchors(flat[at : at + SCAN + LENGTH - 1])
        yield start + at, strings, anchor, content


_FOUND = "part int, blob binary, text_hash long, text_hash2 long, anchor long, content long, start int, strings short"
_ENTRY = np.dtype([("anchor", "u8"), ("content", "u8"), ("text_hash", "i8"), ("text_hash2", "i8"), ("start", "i4"), ("strings", "i2")])
_COLUMNS = [n for n in ("text_hash", "text_hash2", "anchor", "content", "start", "strings")]


def _rows(entries: np.ndarray, schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    n = len(entries)
    columns = [
        pa.array(np.ascontiguousarray(entries[k]).view("i8") if t == pa.int64() else np.ascontiguousarray(entries[k]), t)
        if k in _COLUMNS
        else pa.nulls(n, t)
        for k, t in schema.items()
    ]
    return pa.RecordBatch.from_arrays(columns, list(schema))


_SENT = {"part": pa.int32(), "blob": pa.binary(), "text_hash": pa.int64(), "text_hash2": pa.int64(), "anchor": pa.int64(), "content": pa.int64(), "start": pa.int32(), "strings": pa.int16()}


def _send_anchors(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Entries by range of the anchor's hash; those repeated within the task go as rows, with one marker."""
    waiting: list[np.ndarray] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal count
        if not count:
            return
        entries = np.concatenate(waiting)
        entries = entries[np.argsort(entries["anchor"])]
        a = entries["anchor"]
        first = np.r_[True, a[1:] != a[:-1]]
        lone = first & np.r_[first[1:], True]
        shared = entries[~lone]
        if len(shared):
            rows = _rows(shared, _SENT)
            part = pa.array((np.arange(len(shared)) % ranges).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, *rows.columns[1:]], list(_SENT))
        sent = entries[first]
        sent["strings"][~lone[first]] = 0  # a marker: this anchor is repeated elsewhere
        parts = (sent["anchor"] >> _U(40)).astype(np.int64) * ranges >> 24
        borders = np.searchsorted(parts, np.arange(ranges + 1))
        used = np.flatnonzero(np.diff(borders))
        blobs = [sent[borders[r] : borders[r + 1]].tobytes() for r in used]
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, t) for t in list(_SENT.values())[2:])], list(_SENT)
        )
        waiting.clear()
        count = 0

    for batch in batches:
        for some in slices(batch, "text"):
            for text, text_hash, text_hash2 in zip(*(some.column(c).to_pylist() for c in ("text", "text_hash", "text_hash2"))):
                for start, strings, anchor, content in text_anchors(text.encode()):
                    entries = np.empty(len(start), _ENTRY)
                    entries["text_hash"], entries["text_hash2"] = text_hash, text_hash2
                    entries["start"], entries["strings"], entries["anchor"], entries["content"] = start, strings, anchor, content
                    waiting.append(entries)
                    count += len(entries)
                    if count >= FLUSH:
                        yield from flush()
    yield from flush()


def _meet_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range: entries whose anchor is repeated."""
    schema = dict(list(_SENT.items())[2:])
    blobs: list[np.ndarray] = []
    for batch in batches:
        rest = batch.filter(pa.compute.is_null(batch.column("blob")))
        yield pa.RecordBatch.from_arrays([rest.column(c) for c in schema], list(schema))
        blobs += [np.frombuffer(b, _ENTRY) for b in batch.column("blob").drop_null().to_pylist()]
    if blobs:
        entries = np.concatenate(blobs)
        blobs = []
        entries = entries[np.argsort(entries["anchor"])]
        a = entries["anchor"]
        first = np.r_[True, a[1:] != a[:-1]]
        lone = first & np.r_[first[1:], True]
        entries = entries[~lone & (entries["strings"] > 0)]
        for at in range(0, len(entries), 50_000):
            yield _rows(entries[at : at + 50_000], schema)


def repeated_anchors(docs: DataFrame, ranges: int) -> DataFrame:
    """(text_hash, text_hash2, anchor, content, start, strings) of segments whose anchor is not unique."""
    rows = docs.select("text_hash", "text_hash2", "text").mapInArrow(lambda b: _send_anchors(b, ranges), _FOUND)
    return written(rows.repartition(ranges, "part").mapInArrow(_meet_anchors, _FOUND.partition("blob binary, ")[2]))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Symbol 0 ends a segment; ends differ from each other and order by place."""
    n = len(symbols)
    padded = np.r_[symbols, np.zeros(7, symbols.dtype)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << _U(9) | padded[i : i + n]
    ends = np.flatnonzero(symbols == 0)
    near_end = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n) < 7
    order = np.argsort(key)
    key = key[order]
    # A suffix whose end is within reach is told apart by its end's place.
    short = np.flatnonzero(near_end[order])
    order[short] = order[short[np.lexsort((order[short], key[short]))]]
    apart = np.r_[True, (key[1:] != key[:-1]) | near_end[order[1:]]]
    order = order.astype(np.uint32)
    reach = 7
    rank = np.empty(n, np.uint32)
    group = np.maximum.accumulate(np.where(apart, np.arange(n, dtype=np.uint32), 0))
    rank[order] = group
    open_ = np.flatnonzero(~apart | ~np.r_[apart[1:], True])
    while len(open_):
        places = order[open_]
        # Group and next group in one number: sorted at once.
        key = group[open_].astype(np.uint64) << _U(32) | rank[places + np.uint32(reach)]
        again = np.argsort(key)
        key, places = key[again], places[again]
        order[open_] = places
        first = np.r_[True, key[1:] != key[:-1]]
        group[open_] = np.maximum.accumulate(np.where(first, open_, 0))
        rank[places] = group[open_]
        open_ = open_[~first | ~np.r_[first[1:], True]]
        reach *= 2
    return order.astype(np.int32)


def open_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each suffix whether it shares ``length`` symbols with the one before.

    Breadth-first backward extension: the intervals of level l hold the
    suffixes with a common start of l symbols.  Extending one by the symbols
    that precede its suffixes gives intervals of level l + 1; the end of an
    interval met for the first time fixes a common prefix of l.
    """
    n = len(symbols)
    order = suffix_array(symbols)
    before = symbols[order - 1]  # the transform; the first segment's start meets the last end
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    forward = np.empty(n, np.int32)
    forward[by_symbol] = np.arange(n, dtype=np.int32)
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    after = np.full(n, n, np.int32)  # the next suffix with the same symbol before it
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    earlier = np.full(n, -1, np.int32)
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    fixed = np.zeros(n + 1, bool)  # fixed[i]: the common prefix of suffixes i - 1 and i is known
    # The ends of segments differ from each other: each is an interval of level 1.
    ends = np.arange(np.count_nonzero(symbols == 0), dtype=np.int32)
    fixed[: len(ends) + 1] = fixed[n] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for level in range(length):
        if not len(low):
            break
        sizes = high - low
        total = np.cumsum(sizes)
        rows = np.repeat(low - (total - sizes).astype(np.int32), sizes) + np.arange(total[-1], dtype=np.int32)
        inside = before[rows] > 0
        rows, to, start = rows[inside], np.repeat(high, sizes)[inside], np.repeat(low, sizes)[inside]
        new_high = np.sort(forward[rows[after[rows] >= to]]) + 1
        new_low = np.sort(forward[rows[earlier[rows] < start]])
        fresh = ~fixed[new_high]
        fixed[new_high] = True
        low, high = new_low[fresh], new_high[fresh]
        if level == 0:
            low, high = np.r_[ends, low], np.r_[ends + 1, high]
    return order, ~fixed[:n]


def repeated_starts(segments: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment: starts of strings of ``length`` bytes that occur more than once in all.

    ``weights`` counts how often the whole segment occurs.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    flat = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = flat.astype(np.int16) + 1
    symbols[ends] = 0
    order, joined = open_prefixes(symbols, length)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    own = owner[order]
    whole = ends[own] - order >= length
    first = np.flatnonzero(~joined)
    amount = np.add.reduceat(np.where(whole, weights[own], 0), first)
    often = np.repeat(amount > 1, np.diff(np.r_[first, len(order)])) & whole
    starts = np.zeros(len(flat), bool)
    starts[order[often]] = True
    begins = ends - sizes
    return [np.flatnonzero(starts[b:e]) for b, e in zip(begins, ends)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]]


_RUNS = "anchor long, content long, first int, last int"


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates(["anchor", "content"]).sort_values(["anchor", "content"])
    found = repeated_starts(list(rows["data"]), rows["weight"].to_numpy())
    out = []
    for anchor, content, starts in zip(rows["anchor"], rows["content"], found):
        if len(starts):
            out += [(anchor, content, int(a), int(b)) for a, b in zip(*_runs(starts))]
    kinds = {"anchor": "int64", "content": "int64", "first": "int32", "last": "int32"}
    return pd.DataFrame(out, columns=list(kinds)).astype(kinds)


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments that are ``wanted`` of each text."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("data", pa.binary())])
    for batch in batches:
        for some in slices(batch, "text"):
            out = {n: [] for n in schema.names}
            for text, wanted in zip(some.column("text").to_pylist(), some.column("wanted").to_pylist()):
                raw = text.encode()
                for w in wanted:
                    for n in ("anchor", "content", "weight"):
                        out[n].append(w[n])
                    out["data"].append(raw[w["start"] : w["start"] + w["strings"] + LENGTH - 1])
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _split_segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``width`` string starts each.

    Equal strings have their anchor at equal places, so parts are aligned by
    it, and a part's group is the hash of the bytes that all strings so placed
    have in common: the group of a frequent anchor falls apart by content.
    """
    names = ["whole_anchor", "whole_content", "begin", "anchor", "content", "weight", "data"]
    types = [*[pa.int64()] * 6, pa.binary()]
    for batch in batches:
        out = {n: [] for n in names}
        for anchor, content, weight, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "weight", "data"))):
            strings = len(data) - LENGTH + 1
            mark = int(anchors(np.frombuffer(data, np.uint8))[4][0])
            for j in range(max(0, mark - strings + 1) // width, mark // width + 1):
                # Starts whose distance to the anchor is from j * width on.
                begin, end = max(0, mark - j * width - width + 1), min(strings, mark - j * width + 1)
                common = data[mark - j * width : mark - j * width - width + 1 + LENGTH]
                part = data[begin : end + LENGTH - 1]
                group = _number(j.to_bytes(8, "little") + common)
                for n, v in zip(names, (anchor, content, begin, group, _number(part), weight, part)):
                    out[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)


def _repeated_runs(segments: DataFrame, total: int) -> DataFrame:
    """(anchor, content, first, last): runs of repeated string starts in each segment."""
    buckets = max(1, -(-total // BUCKET))
    return segments.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets))).applyInPandas(_index_bucket, _RUNS)


def _large_runs(segments: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """The same for segments of large groups, which are split until no group is large."""
    width = widths[0]
    schema = "whole_anchor long, whole_content long, begin long, anchor long, content long, weight long, data binary"
    parts = written(segments.mapInArrow(lambda b: _split_segments(b, width), schema))
    once = parts.groupBy("anchor", "content").agg(F.sum("weight").alias("weight"), F.first("data").alias("data"))
    if len(widths) > 1:
        once = written(once)
        sizes = once.groupBy("anchor").agg(F.sum(F.length("data")).alias("bytes"))
        large = sizes.where(F.col("bytes") > LARGE).select("anchor")
        runs = _bucketed(once.join(large, "anchor", "left_anti")).union(
            _large_runs(once.join(large, "anchor", "left_semi"), widths[1:])
        )
    else:
        runs = _bucketed(written(once))
    found = parts.join(runs, ["anchor", "content"])
    return found.select(
        F.col("whole_anchor").alias("anchor"),
        F.col("whole_content").alias("content"),
        (F.col("begin") + F.col("first")).cast("int").alias("first"),
        (F.col("begin") + F.col("last")).cast("int").alias("last"),
    )


def _bucketed(segments: DataFrame) -> DataFrame:
    total = segments.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    return _repeated_runs(segments, total)


def _apply_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove from each text what its repeated strings cover."""
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
    for batch in batches:
        for some in slices(batch, "text"):
            out = {n: [] for n in names}
            for doc_id, text, found in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                raw = text.encode()
                merged: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"]) for r in found or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + LENGTH)
                    else:
                        merged.append([first, last + LENGTH])
                kept, at = [], 0
                for start, end in merged:
                    kept.append(raw[at:start])
                    at = end
                kept.append(raw[at:])
                row = (doc_id, len(raw), sum(e - s for s, e in merged), [{"start": s, "end": e} for s, e in merged], b"".join(kept))
                for n, v in zip(names, row):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)


def remove_repeats(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row of ``docs`` (doc_id, text).

    ``spans`` are the maximal byte runs covered by strings of ``LENGTH`` bytes
    that start anywhere else too; ``kept`` is the rest.  Null texts are empty;
    repeated rows are copies of each other, so nothing of them is kept from
    ``LENGTH`` bytes on.
    """
    ranges = ranges or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = document_keys(docs)
    found = repeated_anchors(docs, ranges)
    place = F.min(F.struct("text_hash", "text_hash2", "start", "strings"))
    distinct = written(
        found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("weight"), place.alias("at")).select("anchor", "content", "weight", "at.*")
    )
    size = F.col("strings").cast("long") + LENGTH - 1
    total = distinct.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    large = distinct.groupBy("anchor").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > LARGE).select("anchor")

    def with_bytes(some: DataFrame, few: bool = False) -> DataFrame:
        wanted = some.groupBy("text_hash", "text_hash2").agg(F.collect_list(F.struct("anchor", "content", "weight", "start", "strings")).alias("wanted"))
        texts = docs.join(F.broadcast(wanted) if few else wanted, ["text_hash", "text_hash2"]).select("text", "wanted")
        return texts.mapInArrow(_cut_segments, "anchor long, content long, weight long, data binary")

    if large.isEmpty():
        runs = _repeated_runs(with_bytes(distinct), total)
    else:
        large = written(large)
        frequent = written(distinct.join(large, "anchor", "left_semi"))
        few = frequent.count() <= BROADCAST_SEGMENTS
        runs = _repeated_runs(with_bytes(distinct.join(large, "anchor", "left_anti")), total).union(
            _large_runs(written(with_bytes(frequent, few).dropDuplicates(["anchor", "content"])), WIDTHS)
        )
    spans = found.join(runs, ["anchor", "content"]).select(
        "text_hash", "text_hash2", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")
    )
    per_text = spans.groupBy("text_hash", "text_hash2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    rows = docs.join(per_text, ["text_hash", "text_hash2"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return rows.mapInArrow(_apply_spans, schema)
