"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``EDITS`` edits share a piece of one of them cut into
``EDITS + 1`` segments.  Lines are probed with the few substrings, by length
and place, that can match; candidates are verified by a banded bit-parallel
edit distance.  Where many lines share a substring, what is left of them without
it is cut into segments again.  Short lines are linked by equality only.  Of each
class of linked lines the first one stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import IDENTITY, components, document_keys, slices, small, written
from termloom.llm.shingles import mix

EDITS = 2
#: Shorter lines are linked with equal ones only: two edits would change what they say.
LEAST_CHARACTERS = 30
#: Segment and probe entries that a task gathers before it sends them on, grouped by hash range.
FLUSH = 500_000
#: Pairs under one probe that are compared at most before its lines are cut again.
PAIRS = 20_000
#: How often lines are cut again; what then shares a probe still is compared in blocks.
CUTS = 2
#: Lines of one side of a search that one task compares at most.
BLOCK = 500
#: Lines that one verifying task gets about.
BIN = 4_000
_U = np.uint64
#: Repeated lines that are broadcast to find their copies; more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Stands for "some line of another task" in an exchanged entry.
_MARK = 2**64 - 2


def segment_cuts(length: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of ``edits + 1`` segments, as even as can be; the longer ones last."""
    base, more = np.divmod(length, edits + 1)
    long = edits + 1 - more  # from this segment on they are longer by one
    return [(base * i + np.maximum(0, i - long), base + (i >= long)) for i in range(edits + 1)]


def probe_places(length: np.ndarray, edits: int = EDITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shift, segment, start, size, valid): the substrings that lines of ``length`` must be probed with.

    With ``shift`` characters more than the indexed line, and i segments to the
    left without a match, the i-th can be moved by i places at most, seen from
    either end.
    """
    for shift in range(edits + 1):
        for i, (start, size) in enumerate(segment_cuts(np.maximum(length - shift, 0), edits)):
            low = np.maximum.reduce([start - i, start + shift - (edits - i), np.zeros_like(start)])
            high = np.minimum.reduce([start + i, start + shift + (edits - i), length - size])
            for step in range(2 * min(i, edits - i) + shift + 1):
                yield shift, i, low + step, size, (low + step <= high) & (length >= shift)


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether ``a`` and ``b`` are at most ``edits`` apart, by bit vectors over the band of diagonals.

    Bit ``i`` of a vector stands for row ``column - edits + i``; each column the
    band moves down one row.  The distance is followed on the diagonal that
    ends in the last cell, on which it never falls.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    # What both begin or end with does not change the distance.
    same = _common(a, b)
    a, b = a[same:], b[same:]
    same = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    more = len(a) - len(b)
    width = 2 * edits + 1
    mask = (1 << width) - 1
    up, down = mask >> edits << edits, 0  # vertical steps of +1 and -1; rows above the first have none
    watched = 1 << edits + more
    distance = max(more, 0)
    padded = "\0" * edits + a + "\0" * (edits + 1)
    last = edits + len(a)
    for column, letter in enumerate(b, 1):
        match = 0
        for i in range(width):
            place = column - 1 + i
            if edits <= place < last and padded[place] == letter:
                match |= 1 << i
        diagonal = (((match & up) + up) ^ up) | match | down
        right = down | ~(diagonal | up)
        left = diagonal & up
        if not diagonal & watched:
            distance += 1
            if distance > edits:
                return False
        diagonal = (diagonal & mask) >> 1
        up = (left | ~(diagonal | right)) & mask
        down = diagonal & right & mask
    return True


#: Code points that are white space, as a table; all lie below its end.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


def _takes_part(line: str) -> bool:
    return bool(line) and not line.isspace()


def _lines_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, takes part) of all lines of ``letters`` (code points, each line ended by a line feed)."""
    ends = np.flatnonzero(letters == 10)
    starts = np.r_[0, ends[:-1] + 1]
    solid = np.r_[0, np.cumsum(~_BLANK[np.minimum(letters, 0x3000)] | (letters > 0x3000))]
    return starts, ends, solid[ends] > solid[starts]


class _Substrings:
    """Hashes of any substrings of a text, from sums over its beginnings."""

    base = 0x9E3779B97F4A7C15
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, letters: np.ndarray):
        if len(self.powers) <= len(letters):
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                factors = np.full(2 * len(letters) + 1, base, np.uint64)
                factors[0] = 1
                setattr(_Substrings, name, np.multiply.accumulate(factors))
        weights = mix(letters.astype(np.uint64) + _U(1)) * self.powers[: len(letters)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])

    def at(self, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + salt.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_SENT = {"part": pa.int32(), "blob": pa.binary(), "key": pa.int64(), "text_hash": pa.int64(), "text_hash2": pa.int64(), "line": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "probe": pa.int64(), "ref": pa.int64(), "role": pa.int64()}
_SENT_SCHEMA = "part int, blob binary, key long, text_hash long, text_hash2 long, line long, h1 long, h2 long, probe long, ref long, role long"
_ENTRY = np.dtype([("probe", "u8"), ("ref", "u8")])


def _batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in schema.items()], list(schema))


def _matched(entries: np.ndarray) -> np.ndarray:
    """For entries by probe value: whether a segment and a probe of different lines meet."""
    first = np.flatnonzero(np.r_[True, entries["probe"][1:] != entries["probe"][:-1]])
    lengths = np.diff(np.r_[first, len(entries)])
    line, role = entries["ref"] >> _U(1), (entries["ref"] & _U(1)).astype(np.int64)
    several = np.minimum.reduceat(line, first) != np.maximum.reduceat(line, first)
    roles = np.add.reduceat(role, first)
    return np.repeat(several & (roles > 0) & (roles < lengths), lengths)


def _send_lines(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """One row a line that takes part, and the segment and probe entries of its text by hash range.

    Entries that meet within the task go as rows of their own; a mark of each
    side tells the other tasks.
    """
    met: set[int] = set()
    waiting: list[np.ndarray] = []
    count = turn = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal count
        if not count:
            return
        entries = np.concatenate(waiting)
        # By probe, then line and side; each once.
        entries = entries[np.lexsort((entries["ref"], entries["probe"]))]
        entries = entries[np.r_[True, entries[1:] != entries[:-1]]]
        hot = _matched(entries)
        known = entries[hot]
        if len(known):
            yield _batch(_SENT, part=(np.arange(len(known)) % ranges), probe=known["probe"].view("i8"), ref=(known["ref"] >> _U(1)).view("i8"), role=(known["ref"] & _U(1)).view("i8"))
            marks = np.repeat(np.unique(known["probe"]), 2)
            known = np.empty(len(marks), _ENTRY)
            known["probe"], known["ref"] = marks, _U(_MARK) | (np.arange(len(marks)) & 1).astype(np.uint64)
        sent = np.concatenate([entries[~hot], known])
        sent = sent[np.argsort(sent["probe"])]
        parts = (sent["probe"] >> _U(40)).astype(np.int64) * ranges >> 24
        borders = np.searchsorted(parts, np.arange(ranges + 1))
        used = np.flatnonzero(np.diff(borders))
        yield _batch(_SENT, part=used, blob=[sent[borders[r] : borders[r + 1]].tobytes() for r in used])
        met.clear()
        waiting.clear()
        count = 0

    def entries_of(hashes: _Substrings, start: np.ndarray, length: np.ndarray, h1: np.ndarray) -> Iterator[np.ndarray]:
        def pack(at: np.ndarray, size: np.ndarray, salt: np.ndarray, ref: np.ndarray) -> np.ndarray:
            out = np.empty(len(at), _ENTRY)
            out["probe"], out["ref"] = hashes.at(at, size, salt), ref
            return out

        segment, probe = h1 >> _U(1) << _U(1), h1 | _U(1)
        for i, (at, size) in enumerate(segment_cuts(length)):
            yield pack(start + at, size, length * 8 + i, segment)
        for shift, i, at, size, valid in probe_places(length):
            yield pack((start + at)[valid], size[valid], ((length - shift) * 8 + i)[valid], probe[valid])

    for batch in batches:
        for some in slices(batch, "text"):
            texts = some.column("text").to_pylist()
            raw = ("\n".join(texts) + "\n").encode("utf-32-le")
            letters = np.frombuffer(raw, np.uint32)
            start, end, joins = _lines_of(letters)
            per_text = np.array([t.count("\n") + 1 for t in texts])
            text_of = np.repeat(np.arange(len(texts)), per_text)
            number = np.arange(len(start)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            start, end, text_of, number = start[joins], end[joins], text_of[joins], number[joins]
            if not len(start):
                continue
            turn += len(start)
            view = memoryview(raw)
            digests = b"".join(xxhash.xxh128_digest(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist()))
            h1, h2 = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            yield _batch(
                _SENT,
                # Dealt in turn: copies of a line may be very many.
                part=np.arange(turn - len(start), turn) % ranges,
                **{c: some.column(c).take(pa.array(text_of)) for c in IDENTITY},
                line=number,
                h1=np.ascontiguousarray(h1).view("i8"),
                h2=np.ascontiguousarray(h2).view("i8"),
            )
            long = (end - start >= LEAST_CHARACTERS).tolist()
            new = [i for i, h in enumerate(h1.tolist()) if long[i] and h not in met and not met.add(h)]
            for entries in entries_of(_Substrings(letters), start[new], (end - start)[new], h1[new]):
                waiting.append(entries)
                count += len(entries)
            if count >= FLUSH:
                yield from flush()
    yield from flush()


def _meet_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: the entries that meet. Other rows pass."""
    schema = dict(list(_SENT.items())[2:])
    blobs: list[np.ndarray] = []
    for batch in batches:
        rest = batch.filter(pa.compute.is_null(batch.column("blob")))
        yield pa.RecordBatch.from_arrays([rest.column(c) for c in schema], list(schema))
        blobs += [np.frombuffer(b, _ENTRY) for b in batch.column("blob").drop_null().to_pylist()]
    if blobs:
        entries = np.concatenate(blobs)
        blobs = []
        entries = entries[np.argsort(entries["probe"])]
        entries = entries[_matched(entries)]
        entries = entries[entries["ref"] >> _U(1) != _U(_MARK) >> _U(1)]
        yield _batch(schema, probe=entries["probe"].view("i8") if len(entries) else [], ref=(entries["ref"] >> _U(1)).view("i8"), role=(entries["ref"] & _U(1)).view("i8"))


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text"):
            nodes, refs, lines = [], [], []
            for text, wanted in zip(some.column("text").to_pylist(), some.column("wanted").to_pylist()):
                cut = text.split("\n")
                for w in wanted:
                    nodes.append(w["node"])
                    refs.append(w["ref"])
                    lines.append(cut[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(refs, pa.int64()), pa.array(lines, pa.string())], ["node", "ref", "text"])


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Links among the lines that met; each pair is compared once."""
    rows = rows.drop_duplicates(["probe", "left", "right", "role", "node"]).sort_values(["probe", "left", "right", "role", "node"])
    group = rows[["probe", "left", "right"]].to_numpy()
    first = np.r_[True, (group[1:] != group[:-1]).any(1)] if len(rows) else np.zeros(0, bool)
    borders = np.r_[np.flatnonzero(first), len(rows)].tolist()
    roles, nodes, texts = (rows[c].tolist() for c in ("role", "node", "text"))
    seen: set[tuple[int, int]] = set()
    links = []
    for start, end in zip(borders, borders[1:]):
        middle = start + roles[start:end].count(0)
        for i in range(start, middle):
            for j in range(middle, end):
                a, b = nodes[i], nodes[j]
                pair = (a, b) if a < b else (b, a)
                if a != b and pair not in seen:
                    seen.add(pair)
                    if within(texts[i], texts[j]):
                        links.append(pair)
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, length) of ``texts`` one after the other."""
    length = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(length) - length, length


_AGAIN = {"probe": pa.int64(), "ref": pa.int64(), "role": pa.int64(), "parent": pa.int64(), "rest": pa.string()}


def _cut_again(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Entries of what is left of each line without the substring by which it met ``probe``.

    Two lines within ``EDITS`` edits share a segment where an alignment with so
    few edits has it too; what that leaves of them is then within ``EDITS``
    edits, and shares a segment in its turn.
    """
    def entries(texts: list[str], role: np.ndarray, parent: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start, size, probe) of the segments of one side and the probes of the other."""
        letters, start, length = _joined(texts)
        hashes = _Substrings(letters)

        def hashed(rows: np.ndarray, at: np.ndarray, size: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
            value = hashes.at(start[rows] + at[rows], size[rows], salt[rows])
            return rows, at[rows], size[rows], mix(value ^ parent[rows]) if level else value

        segments = np.flatnonzero(role == 0)
        for i, (at, size) in enumerate(segment_cuts(length)):
            yield hashed(segments, at, size, length * 8 + i)
        for shift, i, at, size, valid in probe_places(length):
            yield hashed(np.flatnonzero(valid & (role == 1)), at, size, (length - shift) * 8 + i)

    for batch in batches:
        for some in slices(batch, "rest"):
            texts = some.column("rest").to_pylist()
            probe, ref, role, parent = (some.column(c).to_numpy() for c in ("probe", "ref", "role", "parent"))
            places = set()
            for rows, at, size, value in entries(texts, role, parent.view(np.uint64), level):
                hit = value == probe.view(np.uint64)[rows]
                places.update(zip(rows[hit].tolist(), at[hit].tolist(), size[hit].tolist()))
            if not places:
                continue
            rests = pa.array([texts[row][:at] + texts[row][at + size :] for row, at, size in places], pa.string())
            own = np.array([row for row, _, _ in places])
            for rows, _, _, value in entries(rests.to_pylist(), role[own], probe[own].view(np.uint64), level + 1):
                of = own[rows]
                yield _batch(_AGAIN, probe=value.view("i8"), ref=ref[of], role=role[of], parent=probe[of], rest=rests.take(pa.array(rows)))


def _in_blocks(met: DataFrame, sides: DataFrame) -> DataFrame:
    """``met`` (probe, ref, role) with the (left, right) block of its probe in which each copy is compared."""
    own = F.col("role") == 0
    return (
        met.join(sides.select("probe", "lefts", "rights"), "probe")
        .withColumn("mine", F.pmod(F.xxhash64("ref"), F.when(own, F.col("lefts")).otherwise(F.col("rights"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("rights")).otherwise(F.col("lefts")) - 1)))
        .select("probe", "ref", "role", F.when(own, F.col("mine")).otherwise(F.col("other")).alias("left"), F.when(own, F.col("other")).otherwise(F.col("mine")).alias("right"))
    )


def line_links(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between lines (node) at most ``EDITS`` apart, of ``met`` (probe, ref, role).

    Lines of a probe with more than ``PAIRS`` pairs meet anew by what is left of
    them without the substring they share, ``CUTS`` times at most.  Many lines
    that a probe has still are compared in blocks, each in a task of its own.
    """
    dealt, copies = None, 0
    met = met.select("probe", "ref", "role")
    for level in range(CUTS + 1):
        lefts, rights = F.col("n") - F.col("n1"), F.col("n1")
        sides = written(
            met.groupBy("probe")
            .agg(F.sum("role").alias("n1"), F.min("ref").alias("low"), F.max("ref").alias("high"), F.count(F.lit(1)).alias("n"))
            .where((F.col("low") < F.col("high")) & (rights > 0) & (lefts > 0))
            .select(
                "probe",
                ((lefts * rights > PAIRS) & F.lit(level < CUTS)).alias("hot"),
                F.ceil(lefts / BLOCK).cast("int").alias("lefts"),
                F.ceil(rights / BLOCK).cast("int").alias("rights"),
                (lefts * F.ceil(rights / BLOCK) + rights * F.ceil(lefts / BLOCK)).alias("copies"),
            )
        )
        calm = sides.where(~F.col("hot"))
        blocks = _in_blocks(met.select("probe", "ref", "role").distinct() if level else met, calm)
        dealt = blocks if dealt is None else dealt.unionByName(blocks)
        copies += calm.agg(F.sum("copies")).first()[0] or 0
        if not sides.where("hot").take(1):
            break
        hot = met.join(small(sides.where("hot").select("probe"), BROADCAST_LINES), "probe", "left_semi")
        if not level:
            hot = hot.withColumn("parent", F.lit(0).cast("long")).join(texts.select("ref", F.col("text").alias("rest")), "ref")
        hot = hot.select(*_AGAIN)
        again = hot.mapInArrow(lambda b, level=level: _cut_again(b, level), "probe long, ref long, role long, parent long, rest string")
        met = written(again.distinct())
    bins = max(1, copies // BIN)
    rows = dealt.join(texts, "ref").withColumn("bin", F.pmod(F.xxhash64("probe", "left", "right"), F.lit(bins)))
    return rows.groupBy("bin").applyInPandas(_verify, "a long, b long")


def _keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *IDENTITY, "n_lines", "n_joined", "removed", "kept"]
    removed_type = pa.list_(pa.struct([("line", pa.int64()), ("first_doc_id", pa.int64()), ("first_line", pa.int64())]))
    types = [*[pa.int64()] * 6, removed_type, pa.string()]
    for batch in batches:
        for some in slices(batch, "text"):
            out = {n: [] for n in names}
            for *own, text, gone in zip(*(some.column(c).to_pylist() for c in ("doc_id", *IDENTITY, "text", "gone"))):
                lines = text.split("\n") if text else []
                gone = sorted(gone or [], key=lambda g: g["line"])
                numbers = {g["line"] for g in gone}
                kept = "\n".join(line for i, line in enumerate(lines) if i not in numbers)
                for n, v in zip(names, (*own, len(lines), sum(map(_takes_part, lines)), gone, kept)):
                    out[n].append(v)
            carried = [n for n in some.schema.names if n == "carried"]
            columns = [*(pa.array(out[n], t) for n, t in zip(names, types)), *map(some.column, carried)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *carried])


def dedup_lines(docs: DataFrame, ranges: int | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without lines that nearly repeat an earlier one.

    Returns (doc_id, key, text_hash, text_hash2, n_lines, n_joined, removed, kept): how many
    lines the text has and how many take part (``LEAST_CHARACTERS`` or more, not
    blank), the removed ones with the first line of their class, and the rest.
    A class is all lines that links of at most ``EDITS`` edits reach; its first
    line is that of least (doc_id, line).  Null texts are empty, null ids come
    first, and rows that repeat both doc_id and text are one document: each
    gets the same result.  ``carried`` names columns to pass along, in a struct.
    """
    ranges = ranges or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = document_keys(docs, carried)
    sent = docs.select(*IDENTITY, "text").mapInArrow(lambda b: _send_lines(b, ranges), _SENT_SCHEMA)
    rows = written(sent.repartition(ranges, "part").mapInArrow(_meet_lines, _SENT_SCHEMA.partition("blob binary, ")[2]))
    lines = rows.where("h1 IS NOT NULL").select(*IDENTITY, "line", "h1", "h2")
    met = rows.where("probe IS NOT NULL").select("probe", "ref", "role").distinct()
    place = F.struct(*IDENTITY, "line")
    distinct = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    wanted = met.select("ref").distinct()
    reference = F.shiftrightunsigned("h1", 1).alias("ref")
    near = written(
        distinct.select("h1", "h2", "first", reference).join(wanted, "ref").select(F.monotonically_increasing_id().alias("node"), "ref", "h1", "h2", "first")
    )
    by_text = near.groupBy(*[F.col(f"first.{c}").alias(c) for c in IDENTITY]).agg(
        F.collect_list(F.struct("node", "ref", F.col("first.line").alias("line"))).alias("wanted")
    )
    cut = docs.join(by_text, IDENTITY).select("text", "wanted").mapInArrow(_cut_lines, "node long, ref long, text string")
    texts = written(cut.dropDuplicates(["node"]))
    classes = written(components(line_links(met, texts)).join(near, "node").select("component", "h1", "h2", "first"))
    firsts = classes.groupBy("component").agg(F.min("first").alias("class_first"))
    linked = classes.join(firsts, "component").select("h1", "h2", "class_first")
    repeated = (
        distinct.join(linked, ["h1", "h2"], "left")
        .where((F.col("n") > 1) | F.col("class_first").isNotNull())
        .select("h1", "h2", F.coalesce("class_first", "first").alias("keep"))
    )
    # Written, so that a very common line can be split where the join is shuffled.
    repeated = small(repeated, BROADCAST_LINES)
    gone = lines.join(repeated, ["h1", "h2"]).where(place != F.col("keep"))
    source = F.when(F.col("keep.key") != -(2**63), F.col("keep.key"))
    per_text = gone.groupBy(*IDENTITY).agg(
        F.collect_set(F.struct("line", source.alias("first_doc_id"), F.col("keep.line").alias("first_line"))).alias("gone")
    )
    extra = ["carried"] if carried else []
    found = docs.join(per_text, IDENTITY, "left").select("doc_id", *IDENTITY, "text", "gone", *extra)
    schema = "doc_id long, key long, text_hash long, text_hash2 long, n_lines long, n_joined long, removed array<struct<line: long, first_doc_id: long, first_line: long>>, kept string"
    if carried:
        schema += f", carried {docs.schema['carried'].dataType.simpleString()}"
    return found.mapInArrow(_keep_lines, schema)
