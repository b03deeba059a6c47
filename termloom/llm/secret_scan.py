"""Secret scan by grammar inference.

Strings that fixed patterns find are labelled credentials.  Their prefix trees
are merged, state by state where the statistics agree, into probabilistic
automata; other credential-like tokens are then scored by how likely each
format makes them, against an automaton of ordinary tokens.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import slices, written

#: Fixed patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: As short as a fixed pattern lets a credential be.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: The kind of spans that the automata add, last in order.
INFERRED = "inferred"
#: Distinct labelled strings of a kind that an automaton is built from at most: those of least hash.
SAMPLE = 1_000
#: Longer strings are found and scored, but no automaton is built from them.
LONGEST = 500
#: Ordinary tokens are sampled for each length; from this one on together.
_LENGTHS = 32
#: Judgements that a task remembers, of tokens up to 64 characters.
REMEMBERED = 50_000
#: Confidence of the test by which two states differ.
ALPHA = 0.05
#: Share of the labelled strings that may score below the limit of their own automaton.
MISSED = 0.02
#: Log-likelihood by character that a credential must have over ordinary tokens.
MARGIN = 0.5
#: Probability left for symbols that a state has not met.
_SMOOTH = 1e-3
_SYMBOLS = 67


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) of the fixed patterns, by start, then kind.

    Matches are found leftmost first for each kind; those too short are dropped
    after they were found.
    """
    found = [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hex digits is found whole, so asking for 24 at once drops the same ones.
    found += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens of 6 characters and more that touch none of the spans."""
    out = []
    starts = [s[0] for s in spans]
    ends = np.maximum.accumulate([s[2] for s in spans]).tolist() if spans else []
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            out.append((m.start(), m.end(), m.group()))
    return out


@dataclass
class State:
    arrivals: int = 0
    ends: int = 0
    steps: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


@dataclass
class Automaton:
    """A probabilistic automaton of a format.

    A string is of the format if its length lies within those labelled and its
    score reaches ``limit``.
    """

    states: list[State]
    limit: float = 0.0
    shortest: int = 0
    longest: int = 0

    def fits(self, text: str) -> bool:
        return self.shortest <= len(text) <= self.longest and self.score(text) >= self.limit

    def score(self, text: str) -> float:
        """Log-likelihood of ``text`` by symbol, its end included."""
        at, total = 0, 0.0
        for symbol in text:
            state = self.states[at] if at is not None else None
            if state is None or symbol not in state.steps:
                total += math.log(_SMOOTH / _SYMBOLS)
                at = at if state is not None else None
                continue
            total += math.log((1 - _SMOOTH) * state.steps[symbol] / state.arrivals)
            at = state.to[symbol]
        state = self.states[at]
        total += math.log((1 - _SMOOTH) * state.ends / state.arrivals + _SMOOTH / _SYMBOLS)
        return total / (len(text) + 1)


def _differ(n1: int, f1: int, n2: int, f2: int, bound: float) -> bool:
    """Hoeffding's test on two shares."""
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings``.

    States next to the finished ones are tried, those of most arrivals first,
    against each finished state; one that fits none becomes finished itself.
    """
    states = [State()]
    for text in sorted(strings):
        at = 0
        states[0].arrivals += 1
        for symbol in text:
            state = states[at]
            state.steps[symbol] = state.steps.get(symbol, 0) + 1
            if symbol not in state.to:
                state.to[symbol] = len(states)
                states.append(State())
            at = state.to[symbol]
            states[at].arrivals += 1
        states[at].ends += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = (states[i] for i in todo.pop())
            if _differ(x.arrivals, x.ends, y.arrivals, y.ends, bound):
                return False
            for symbol in x.steps.keys() | y.steps.keys():
                if _differ(x.arrivals, x.steps.get(symbol, 0), y.arrivals, y.steps.get(symbol, 0), bound):
                    return False
                if symbol in x.to and symbol in y.to:
                    todo.append((x.to[symbol], y.to[symbol]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = states[a], states[b]
            x.arrivals += y.arrivals
            x.ends += y.ends
            for symbol, count in y.steps.items():
                x.steps[symbol] = x.steps.get(symbol, 0) + count
                if symbol in x.to:
                    todo.append((x.to[symbol], y.to[symbol]))
                else:
                    x.to[symbol] = y.to[symbol]

    finished = [0]
    done = {0}
    while True:
        edge = {t: (s, symbol) for s in finished for symbol, t in states[s].to.items() if t not in done}
        if not edge:
            break
        blue = max(edge, key=lambda t: (states[t].arrivals, -t))
        source, symbol = edge[blue]
        for red in finished:
            if compatible(red, blue):
                states[source].to[symbol] = red
                fold(red, blue)
                break
        else:
            finished.append(blue)
            done.add(blue)
    number = {s: i for i, s in enumerate(finished)}
    kept = [State(states[s].arrivals, states[s].ends, states[s].steps, {c: number[t] for c, t in states[s].to.items()}) for s in finished]
    out = Automaton(kept)
    if strings:
        out.limit = float(np.quantile([out.score(t) for t in strings], MISSED))
        out.shortest, out.longest = min(map(len, strings)), max(map(len, strings))
    return out


class _Least:
    """The ``most`` strings of least hash among those added."""

    def __init__(self, most: int):
        self.most, self.kept, self.limit = most, {}, 2**64

    def add(self, text: str) -> None:
        value = xxhash.xxh64_intdigest(text)
        if value < self.limit:
            self.kept[text] = value
            if len(self.kept) >= 2 * self.most + 64:
                self.cut()

    def cut(self) -> None:
        some = sorted(self.kept.items(), key=lambda x: (x[1], x[0]))[: self.most]
        self.kept = dict(some)
        if len(some) == self.most:
            self.limit = some[-1][1] + 1


def labelled(docs: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[list[str], int, int]]:
    """(strings, shortest, longest) of each kind, and of ordinary tokens ("other").

    The lengths are those of all strings that the fixed patterns find.  The
    strings are at most ``sample`` distinct ones up to ``LONGEST`` characters,
    those of least hash; ordinary tokens are as long as the shortest labelled
    string or longer.  A task sends no more than the sample of each kind and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[str, int], _Least] = {}
        lengths: dict[str, tuple[int, int]] = {}
        for batch in batches:
            for some in slices(batch, "text"):
                found: set[tuple[str, str]] = set()
                for text in some.column("text").to_pylist():
                    spans = base_spans(text or "")
                    found.update((KINDS[s[1]], s[3]) for s in spans)
                    found.update(("other", c[2]) for c in candidates(text or "", spans))
                for kind, string in found:
                    n = len(string)
                    if kind != "other":
                        low, high = lengths.get(kind, (n, n))
                        lengths[kind] = min(low, n), max(high, n)
                    if n <= LONGEST:
                        group = kind, min(n, _LENGTHS) if kind == "other" else 0
                        if group not in least:
                            least[group] = _Least(sample)
                        least[group].add(string)
        for group in least.values():
            group.cut()
        rows = [(kind, text, value - 2**63, None, None) for (kind, _), group in least.items() for text, value in group.kept.items()]
        rows += [(kind, None, None, *n) for kind, n in lengths.items()]
        columns = zip(*rows) if rows else [[]] * 5
        types = [pa.string(), pa.string(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "string", "hash", "low", "high"])

    rows = written(docs.select("text").mapInArrow(run, "kind string, string string, hash long, low long, high long"))
    ends = rows.where("string IS NULL").groupBy("kind").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    lengths = {r.kind: (r.low, r.high) for r in ends}
    shortest = min([n for n, _ in lengths.values()], default=0)
    fit = rows.where(F.col("string").isNotNull() & ((F.col("kind") != "other") | (F.length("string") >= min(shortest, _LENGTHS))))
    out = {}
    for kind in (*KINDS, "other"):
        some = fit.where(F.col("kind") == kind).select("hash", "string").distinct().orderBy("hash", "string").limit(sample)
        out[kind] = ([r.string for r in some.collect()], *lengths.get(kind, (0, 0)))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton for each kind that has labelled strings, and for other tokens."""
    out = {}
    for kind, (strings, shortest, longest) in labelled(docs, sample).items():
        if strings:
            out[kind] = infer(strings)
            out[kind].shortest, out[kind].longest = shortest, longest
    return out


class Judge:
    """Tells what credential-like tokens are; remembers the common ones."""

    def __init__(self, automata: dict[str, Automaton]):
        self.formats = [a for k, a in automata.items() if k != "other"]
        self.other = automata.get("other")
        self.shortest = min((a.shortest for a in self.formats), default=0)
        self.longest = max((a.longest for a in self.formats), default=-1)
        self.remembered = lru_cache(REMEMBERED)(self.gain)

    def gain(self, token: str) -> float:
        """By how much some format explains ``token`` better than ordinary tokens do; -inf where none fits."""
        fits = [s for a in self.formats if a.shortest <= len(token) <= a.longest and (s := a.score(token)) >= a.limit]
        if not fits:
            return -math.inf
        return max(fits) - (self.other.score(token) if self.other else -math.log(_SYMBOLS))

    def __call__(self, token: str) -> float:
        if not self.shortest <= len(token) <= self.longest:
            return -math.inf
        return self.remembered(token) if len(token) <= 64 else self.gain(token)


def inferred_spans(text: str, spans: list, judge: Judge) -> list[tuple[int, int, float]]:
    """(start, end, gain) of tokens that some format explains, better than ordinary tokens do.

    All tokens as long as the labelled strings are scored.  Those that touch a
    base span are left out: what they hold is reported already.
    """
    out = [(m.start(), m.end(), gain) for m in _CANDIDATE.finditer(text) if (gain := judge(m.group())) >= MARGIN]
    if out and spans:
        free = {c[:2] for c in candidates(text, spans)}
        out = [o for o in out if o[:2] in free]
    return out


def scan(docs: DataFrame, automata: dict[str, Automaton]) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with n_assign, n_access, n_hex, base and spans.

    ``base`` and ``spans`` list ``kind:start:end`` by start, then kind, joined by
    commas, in code points; ``spans`` adds those that the automata found.  Null
    texts are empty; rows are scanned one by one, so copies get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: vars(a) | {"states": [vars(s) for s in a.states]} for k, a in automata.items()})
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
    types = [*[pa.int64()] * 4, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Judge({k: Automaton(**a | {"states": [State(**s) for s in a["states"]]}) for k, a in shared.value.items()})
        for batch in batches:
            for some in slices(batch, "text"):
                out = {n: [] for n in names}
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    text = text or ""
                    spans = base_spans(text)
                    more = [(start, len(KINDS), end) for start, end, _ in inferred_spans(text, spans, known)]
                    labels = (*KINDS, INFERRED)
                    base = ",".join(f"{labels[k]}:{s}:{e}" for s, k, e, _ in spans)
                    both = sorted([s[:3] for s in spans] + more)
                    counts = [sum(s[1] == k for s in spans) for k in range(3)]
                    for n, v in zip(names, (doc_id, *counts, base, ",".join(f"{labels[k]}:{s}:{e}" for s, k, e in both))):
                        out[n].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
