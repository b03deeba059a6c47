"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct words are put into matrices by length; each round every row merges its
leftmost pair of least rank, found by a hashed pair lookup, and is compacted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import SLICE_BYTES, slices

NONE = np.int32(2**31 - 1)
#: Rows longer than this many bytes are merged one at a time, all safe places of a pair at once.
LONGEST_ROW = 64
#: Words that a task remembers before it starts afresh.
REMEMBERED_WORDS = 200_000
#: Words of one text that are held at once.
WORDS_AT_ONCE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Arrays of a rank file: byte ids, token bytes, and the hashed pair table."""

    byte_ids: np.ndarray
    token_bytes: np.ndarray
    token_starts: np.ndarray
    shift: int
    keys: np.ndarray
    ranks: np.ndarray
    safe: np.ndarray

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; ``NONE`` where the pair does not merge."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        wanted = (left[open_].astype(np.uint64) << np.uint64(32)) | right[open_].astype(np.uint64)
        slot = (wanted * _MIX) >> np.uint64(self.shift)
        while len(open_):
            found = self.keys[slot]
            hit = found == wanted
            out[open_[hit]] = self.ranks[slot[hit]]
            rest = ~hit & (found != np.uint64(2**64 - 1))
            open_, wanted = open_[rest], wanted[rest]
            slot = (slot[rest] + np.uint64(1)) & np.uint64(len(self.keys) - 1)
        return out.reshape(shape)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a rank file (base64 token, rank) on the driver; its size is the vocabulary's."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, rank in ranks.items():
        by_id[rank] = token
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    bits = max(4, int(np.ceil(np.log2(len(pairs) * 2 + 1))))
    shift = 64 - bits
    keys = np.full(1 << bits, 2**64 - 1, np.uint64)
    values = np.full(1 << bits, NONE, np.int32)
    todo = np.fromiter(pairs, np.uint64, len(pairs))
    todo_ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
    slot = (todo * _MIX) >> np.uint64(shift)
    while len(todo):
        free = np.flatnonzero(keys[slot] == np.uint64(2**64 - 1))
        _, first = np.unique(slot[free], return_index=True)
        placed = free[first]
        keys[slot[placed]], values[slot[placed]] = todo[placed], todo_ranks[placed]
        rest = np.ones(len(todo), bool)
        rest[placed] = False
        todo, todo_ranks = todo[rest], todo_ranks[rest]
        taken = keys[slot[rest]] != np.uint64(2**64 - 1)
        slot = (slot[rest] + taken.astype(np.uint64)) & np.uint64(len(keys) - 1)
    # A token is safe if no pair that contains it ranks before it: then all its
    # pairs in a row may be merged at once.
    safe = np.ones(size, bool)
    for pair, rank in pairs.items():
        for part in (pair >> 32, pair & 0xFFFFFFFF):
            if rank < part:
                safe[part] = False
    lengths = np.fromiter(map(len, by_id), np.int64, size)
    return Vocabulary(
        np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        np.frombuffer(b"".join(by_id), np.uint8),
        np.concatenate([[0], np.cumsum(lengths)]),
        shift,
        keys,
        values,
        safe,
    )


def _merge_matrix(words: list[bytes], width: int, vocab: Vocabulary) -> list[np.ndarray]:
    """Token ids of words of at most ``width`` bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    ids = np.full((len(words), width), -1, np.int32)
    ids[np.arange(width) < lengths[:, None]] = vocab.byte_ids[flat]
    ranks = vocab.pair_ranks(ids[:, :-1], ids[:, 1:])
    out: list[np.ndarray] = [None] * len(words)
    row_of = np.arange(len(words))
    while True:
        best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
        lowest = ranks[np.arange(len(ids)), best] if ranks.shape[1] else np.full(len(ids), NONE)
        done = lowest == NONE
        for i in np.flatnonzero(done):
            out[row_of[i]] = ids[i][ids[i] >= 0]
        live = ~done
        if not live.any():
            return out
        ids, ranks, best, lowest, row_of = ids[live], ranks[live], best[live], lowest[live], row_of[live]
        at = np.arange(len(ids))
        ids[at, best] = lowest
        keep = np.arange(ids.shape[1]) != (best + 1)[:, None]
        ids = ids[keep].reshape(len(ids), -1)
        keep = np.arange(ranks.shape[1]) != best[:, None]
        ranks = ranks[keep].reshape(len(ids), -1)
        if ranks.shape[1]:
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < ranks.shape[1])
            b = best[before]
            ranks[before, b - 1] = vocab.pair_ranks(ids[before, b - 1], ids[before, b])
            b = best[after]
            ranks[after, b] = vocab.pair_ranks(ids[after, b], ids[after, b + 1])


def _merge_long(word: bytes, vocab: Vocabulary) -> np.ndarray:
    """Token ids of one long word: a one-row matrix that merges all safe places of a rank at once."""
    ids = vocab.byte_ids[np.frombuffer(word, np.uint8)]
    ranks = vocab.pair_ranks(ids[:-1], ids[1:])
    while len(ranks) and (lowest := ranks.min()) != NONE:
        places = np.flatnonzero(ranks == lowest)
        if not vocab.safe[lowest]:
            places = places[:1]
        else:  # in a run of overlapping pairs, every second one
            new_run = np.r_[True, np.diff(places) > 1]
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - start) % 2 == 0]
        ids[places] = lowest
        keep = np.ones(len(ids), bool)
        keep[places + 1] = False
        ids = ids[keep]
        merged = places - np.arange(len(places))
        keep = np.ones(len(ranks), bool)
        keep[places] = False
        ranks = ranks[keep]
        for pos in (merged[merged > 0] - 1, merged[merged < len(ranks)]):
            ranks[pos] = vocab.pair_ranks(ids[pos], ids[pos + 1])
    return ids


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Token ids of each word; words share a matrix with others of about their length."""
    out: list[np.ndarray] = [None] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) > LONGEST_ROW:
            out[i] = _merge_long(word, vocab)
        else:
            width = len(word) if len(word) <= 8 else -(-len(word) // 4) * 4
            by_width.setdefault(width, []).append(i)
    for width, places in by_width.items():
        for at in range(0, len(places), 20_000):
            some = places[at : at + 20_000]
            for i, ids in zip(some, _merge_matrix([words[i] for i in some], width, vocab)):
                out[i] = ids
    return out


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs (start, length) of ``flat``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes texts; remembers the words it has met."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.pattern = vocab, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)

    def _learn(self, words: set[str]) -> None:
        words = list(words)
        ids = merge_words([w.encode() for w in words], self.vocab)
        first, count = len(self.place), len(words)
        while len(self.starts) < first + count:
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        lengths = np.fromiter(map(len, ids), np.int64, count)
        while len(self.flat) < self.used + lengths.sum():
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + lengths.sum()] = np.concatenate(ids)
        self.starts[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + count] = lengths
        self.used += int(lengths.sum())
        self.place.update(zip(words, range(first, first + count)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if sum(map(len, texts)) > 2 * SLICE_BYTES:
            return [self._encode_long(t) if len(t) > SLICE_BYTES else self.encode([t])[0] for t in texts]
        words = [self.pattern.findall(t) for t in texts]
        ids, counts = self._ids([w for some in words for w in some], list(map(len, words)))
        ends = np.cumsum(counts)
        return [ids[e - c : e].tobytes() for e, c in zip(ends, counts)]

    def _encode_long(self, text: str) -> bytes:
        found = (m.group() for m in self.pattern.finditer(text))
        parts = []
        while some := list(islice(found, WORDS_AT_ONCE)):
            parts.append(self._ids(some, [len(some)])[0].tobytes())
        return b"".join(parts)

    def _ids(self, words: list[str], per_text: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > REMEMBERED_WORDS:
            self._forget()
        if new := set(words).difference(self.place):
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(np.array(per_text, np.int64))
        counts = total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else ends
        return _gather(self.flat, self.starts[at], lengths).astype("<u4"), counts


def encode(docs: DataFrame, vocab: Vocabulary, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` replaced by ``ids``: little-endian unsigned 32-bit token ids.

    Null texts count as empty and give no ids.  Each row is handled alone, so
    repeated rows, null keys and extra columns pass through as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocab))
    kept = [f for f in docs.schema.fields if f.name not in (column, "ids")]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(column, F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shared.value), pattern)
        for batch in batches:
            for some in slices(batch, "__text"):
                ids = encoder.encode(some.column("__text").to_pylist())
                columns = [some.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ids, pa.binary())], [*(f.name for f in kept), "ids"]
                )

    schema = source.select(*[F.col(f"`{f.name}`") for f in kept], F.lit(b"").alias("ids")).schema
    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: Vocabulary, column: str = "ids") -> DataFrame:
    """``rows`` with ``bytes``: what the ids in ``column`` stand for; null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(vocab))
    kept = [f for f in rows.schema.fields if f.name != "bytes"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**shared.value)
        for batch in batches:
            for some in slices(batch, column):
                out = []
                for ids in some.column(column).to_pylist():
                    ids = np.frombuffer(ids or b"", "<u4").astype(np.int64)
                    parts = []
                    for at in range(0, len(ids), WORDS_AT_ONCE):
                        i = ids[at : at + WORDS_AT_ONCE]
                        parts.append(_gather(v.token_bytes, v.token_starts[i], v.token_starts[i + 1] - v.token_starts[i]).tobytes())
                    out.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(out, pa.binary())], [*names, "bytes"])

    source = rows.select(*[F.col(f"`{n}`") for n in names])
    return source.mapInArrow(run, source.withColumn("bytes", F.lit(b"")).schema)
