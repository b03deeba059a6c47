"""Stretches of text that repeat themselves with a fixed period of words.

A *run* is a stretch whose words equal those one period further on, at least
two periods long, that neither neighbouring word extends.  Short periods are
read off by comparing the text with itself, moved by that many words.  Longer
ones come from string synchronising sets: at each scale, positions are chosen
by the hashes of the words around them alone, so that equal passages have
equal choices; two chosen positions with equal contexts propose their distance
as a period, and the longest common extensions of both give the run.  Highly
periodic stretches have no chosen positions.  They are runs of a short period,
known from smaller scales, and where two of one period touch, the longer
periods that only such a seam can have are derived from their phases.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import slices

#: Words that a run has at least.
LEAST_WORDS = 12
#: The smallest scale; periods below three times this, less one, are compared directly.
FIRST_SCALE = 4
#: Hashes are kept for stretches of up to 2 ** LEVELS words; longer ones are passed in steps of that size.
LEVELS = 12

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class HashCollision(Exception):
    """Stretches of equal hash were found to differ."""


@dataclass
class Runs:
    """Runs as arrays of first word, word after the last, and smallest period."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray

    def where(self, mask: np.ndarray) -> Runs:
        return Runs(self.start[mask], self.end[mask], self.period[mask])

    def with_more(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Runs:
        """Both, and of those with equal ends only the one of smallest period."""
        start, end, period = (np.concatenate(p) for p in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return Runs(start[first], end[first], period[first])


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _double(names: np.ndarray, step: int) -> np.ndarray:
    """Hashes of stretches twice as long as those of ``names``, which are ``step`` words long."""
    return _mix(names[:-step] * np.uint64(0x9E3779B97F4A7C15) + names[step:] * np.uint64(0xC2B2AE3D27D4EB4F))


def _extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    """Words that are equal from ``a`` and ``b`` > ``a`` on, to the right (side 1) or, before them, to the left (-1)."""
    n = len(levels[0])
    done = np.zeros(len(a), np.int64)

    def step(level: int, some: np.ndarray) -> np.ndarray:
        size = 1 << level
        shift = done[some] if side > 0 else -done[some] - size
        x, y = a[some] + shift, b[some] + shift
        inside = (y + size <= n) if side > 0 else (x >= 0)
        x, y, some = x[inside], y[inside], some[inside]
        equal = some[levels[level][x] == levels[level][y]]
        done[equal] += size
        return equal

    some, top = np.arange(len(a)), len(levels) - 1
    while len(some):
        some = step(top, some)
    for level in range(top - 1, -1, -1):
        step(level, np.arange(len(a)))
    return done


def _compared(ids: np.ndarray) -> Runs:
    """Runs of the periods below three times the first scale; those of 1 and 2 also when shorter than reported."""
    found = []
    for p in range(1, min(3 * FIRST_SCALE - 1, len(ids))):
        # A window of the scale that is the first to have p within a third must be covered.
        least = {1: 4, 2: 8}.get(p, max(LEAST_WORDS, 2 * p))
        equal = np.zeros(len(ids) - p + 2, np.int8)
        equal[1:-1] = ids[p:] == ids[:-p]
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        start, end = edges[::2], edges[1::2] + p
        long = end - start >= least
        found.append((start[long], end[long], np.full(long.sum(), p, np.int64)))
    none = np.zeros(0, np.int64)
    parts = [np.concatenate(p) for p in zip(*found)] if found else [none] * 3
    return Runs(none, none, none).with_more(*parts)


def _covered(runs: Runs, before: int, n: int) -> np.ndarray:
    """Mask of ``n`` positions from which ``before`` words lie within one of the runs."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, runs.start, 1)
    np.add.at(change, runs.end - before + 1, -1)
    return np.cumsum(change[:n]) > 0


def synchronising(names: np.ndarray, periodic: np.ndarray | None, scale: int) -> np.ndarray:
    """Positions of the synchronising set of ``scale``.

    ``names`` are hashes of ``scale`` words, ``periodic`` marks those of period
    a third or less.  Position i is chosen if the least hash among the other
    ones in [i, i + scale] stands at either end: that depends on 2 * scale
    words only, and of ``scale`` neighbours one is chosen, unless the
    3 * scale - 1 words from the first on have a period of a third or less.
    """
    none = np.uint64(2**64 - 1)
    # An order of its own for each scale, or positions would favour the same words throughout.
    order = _mix(names ^ np.uint64(0x2545F4914F6CDD1D * scale % 2**64))
    if periodic is not None:
        order[periodic] = none
    least, width = order, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(order) - scale], order[scale:])
    return np.flatnonzero(((least == order[: len(least)]) | (least == order[scale:])) & (least != none))


def _proposed(chosen: np.ndarray, contexts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of chosen positions with equal contexts, ``least`` <= distance < ``most``."""
    order = np.argsort(contexts, kind="stable")
    contexts, chosen = contexts[order], chosen[order]
    some, lag = np.arange(len(chosen)), 0
    at, far = [], []
    while len(some):
        lag += 1
        some = some[some + lag < len(chosen)]
        distance = chosen[some + lag] - chosen[some]
        near = (contexts[some + lag] == contexts[some]) & (distance < most)
        some, distance = some[near], distance[near]
        at.append(chosen[some[distance >= least]])
        far.append(distance[distance >= least])
    if not at:
        return chosen[:0], chosen[:0]
    return np.concatenate(at), np.concatenate(far)


def _seams(ids: np.ndarray, runs: Runs, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) where two runs of one short period touch, by the phases of both.

    ``runs`` are at least ``least`` words long; a stretch of period p that
    repeats once across the seam has p congruent to the difference of phase.
    """
    order = np.lexsort((runs.start, runs.period))
    start, end, period = runs.start[order], runs.end[order], runs.period[order]
    at, far = [], []
    for i in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1])).tolist():
        x1, y1, x2, y2, q = start[i], end[i], start[i + 1], end[i + 1], int(period[i])
        root = ids[x2 : x2 + q]
        for phase in np.flatnonzero(ids[x1 : x1 + q] == ids[x2]).tolist():
            if np.array_equal(ids[x1 + phase : x1 + phase + q], root):
                low = least + (x2 - x1 - phase - least) % q
                distances = np.arange(low, min(most, y1 - x1 + 1, y2 - x2 + 1), q)
                at.append(y1 - distances)
                far.append(distances)
                break
    if not at:
        return start[:0], start[:0]
    return np.concatenate(at), np.concatenate(far)


def _check(ids: np.ndarray, runs: Runs, most: int = 1 << 22) -> None:
    """Compare the words of ``runs``, about ``most`` at once."""
    sizes = runs.end - runs.start - runs.period
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = sizes[at:stop]
        left = np.repeat(runs.start[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not np.array_equal(ids[left], ids[left + np.repeat(runs.period[at:stop], n)]):
            raise HashCollision
        at = stop


def runs_of(ids: np.ndarray, ends: np.ndarray, seed: int = 0) -> Runs:
    """All runs of ``LEAST_WORDS`` words or more in the texts whose word numbers ``ids`` holds.

    The texts follow each other, longest first; ``ends`` are their ends, and
    each is followed by one number of its own, which parts it from the next.
    """
    runs = _compared(ids)
    lengths = np.diff(ends, prepend=-1) - 1
    longest = int(lengths.max(initial=0))
    levels = [_mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1))]
    while len(levels) <= LEVELS and 2 << (len(levels) - 1) <= longest:
        levels.append(_double(levels[-1], 1 << (len(levels) - 1)))
    scale, level = FIRST_SCALE, FIRST_SCALE.bit_length() - 1
    names = levels[level] if level < len(levels) else None
    while 2 * (3 * scale - 1) <= longest:
        # Only texts that can hold two of the scale's shortest periods; they come first.
        n = int(ends[np.searchsorted(-lengths, -2 * (3 * scale - 1), "right") - 1]) + 1
        names = names[: n - scale + 1]
        twice = levels[level + 1][: n - 2 * scale + 1] if level + 1 < len(levels) else _double(names, scale)
        short = runs.where((3 * runs.period <= scale) & (runs.end - runs.start >= scale) & (runs.end <= n))
        periodic = _covered(short, scale, len(names)) if len(short.start) else None
        chosen = synchronising(names, periodic, scale)
        least, most = 3 * scale - 1, 6 * scale - 1
        at, far = _proposed(chosen, twice[chosen], least, most)
        # Neighbours that propose one period within their equal contexts are of one run.
        order = np.lexsort((at, far))
        at, far = at[order], far[order]
        new = np.ones(len(at), bool)
        new[1:] = (far[1:] != far[:-1]) | (at[1:] - at[:-1] > 2 * scale)
        more = _seams(ids, short.where(short.end - short.start >= least), least, most)
        at, far = np.concatenate([at[new], more[0]]), np.concatenate([far[new], more[1]])
        start = at - _extend(levels, at, at + far, -1)
        end = at + far + _extend(levels, at, at + far, 1)
        long = end - start >= 2 * far
        runs = runs.with_more(start[long], end[long], far[long])
        names, scale, level = twice, 2 * scale, level + 1
    runs = runs.where(runs.end - runs.start >= np.maximum(LEAST_WORDS, 2 * runs.period))
    _check(ids, runs)
    return runs


def _slice(some: pa.RecordBatch) -> pa.RecordBatch:
    words = [(text or b"").split() for text in some.column("text").cast(pa.binary()).to_pylist()]
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.empty(int(sizes.sum()) + len(words), np.int64)
    ends = np.cumsum(sizes[order] + 1) - 1
    part = np.zeros(len(ids), bool)
    part[ends] = True
    every = itertools.chain.from_iterable(words[d] for d in order)
    ids[~part] = np.fromiter(map(number.__getitem__, every), np.int64, int(sizes.sum()))
    ids[ends] = len(number) + np.arange(len(words))
    for seed in itertools.count():
        try:
            runs = runs_of(ids, ends, seed)
            break
        except HashCollision:
            continue
    again = np.zeros(len(ids) + 1, np.int64)
    np.add.at(again, runs.start + runs.period, 1)
    np.add.at(again, runs.end, -1)
    again = np.cumsum(again) > 0
    owner = order[np.searchsorted(ends, runs.start)]
    begins = np.empty(len(words), np.int64)
    begins[order] = ends - sizes[order]
    rank = np.lexsort((runs.period, runs.start, owner))
    start, owner = runs.start[rank], owner[rank]
    fields = [start - begins[owner], (runs.end - runs.start)[rank], runs.period[rank]]
    offsets = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
    kept = []
    for d, own in enumerate(words):
        if offsets[d] < offsets[d + 1]:
            own = itertools.compress(own, ~again[begins[d] : begins[d] + sizes[d]])
        kept.append(b" ".join(own))
    found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(_RUN)))
    columns = [some.column("doc_id"), pa.array(sizes), found, pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with n_words, runs and collapsed.

    Words are what blanks and control characters 9 to 13 part.  ``runs`` is an
    array of (start, length, period) by start, then period; ``collapsed`` joins
    by blanks the words that no run holds after its first period.  Null and
    blank texts have no words and no runs; rows are judged one by one, so
    repeated and null doc_ids each give a row, and other columns are ignored.
    A text is held whole, with about 150 bytes a word; short ones share a pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                yield _slice(some)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return source.mapInArrow(run, types)
