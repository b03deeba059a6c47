"""WARC archives and a two-level capture index.

Every record is a gzip member of its own, so that it can be read by its byte
range.  Captures are sorted by reversed-host URL key into compressed blocks; a
sparse directory holds the first key of each block.  A lookup searches the
directory, then one block, by halving, and only then reads the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import slices, written

#: Payloads from this size on are stored once; equal ones are revisits.
REVISIT_BYTES = 1_000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Captures in a compressed block of the index, and in one of its parts.
BLOCK_CAPTURES = 1_000
PART_CAPTURES = 100_000
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Sorts before all ids, and stands for null where keys are compared.
NO_ID = -(2**63)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then the rest; empty for null."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[^:/?#]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, record_type and refers_to.

    Of equal payloads of ``REVISIT_BYTES`` or more the one with the largest
    page_id is the response.  Rows that repeat that page_id are responses too; a
    null id is smaller than any other.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    rank = F.coalesce("page_id", F.lit(NO_ID))
    # Only payloads that occur twice are joined back, so the rest needs no partner.
    several = (
        rows.where(F.length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("main"))
        .where("n > 1")
        .select("digest", "main")
    )
    again = F.col("main").isNotNull() & (rank != F.col("main"))
    return rows.join(several, "digest", "left").select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        F.length("payload").cast("long").alias("payload_bytes"),
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("main")).alias("refers_to"),
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _header_safe(text: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_safe(url) if url else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload and payload size of one record; raises where its lengths or digest disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block, tail = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("the record is longer or shorter than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload is not what its digest says")
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    return {
        "page_id": int(page) if page else None,
        "record_type": kind,
        "refers_to": int(refers) if refers and int(refers) != NO_ID else None,
        "payload_bytes": size,
        "digest": digest,
        "payload": payload if kind == "response" else None,
    }


_CAPTURE = "url_key string, id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` (any file system that Arrow knows) and list the captures.

    Returns (url_key, id, file, offset, length), already written as a table: a
    task that runs again writes files of new names, and only the files of
    the attempt that counted are listed.
    """
    columns = ["page_id", "url", "payload", "payload_bytes", "digest", "record_type", "refers_to", "url_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                for some in slices(batch, "payload"):
                    found: dict[str, list] = {"url_key": [], "id": [], "file": [], "offset": [], "length": []}
                    for *row, key in zip(*(some.column(c).to_pylist() for c in columns)):
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{base}/{name}", compression=None)
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(record(*row)) + pack.flush()
                        out.write(member)
                        place = (key, NO_ID if row[0] is None else row[0], name, at, len(member))
                        for n, v in zip(found, place):
                            found[n].append(v)
                        at += len(member)
                    yield pa.RecordBatch.from_pydict(found)
        finally:
            if out is not None:
                out.close()

    rows = record_types(pages).withColumn("url_key", url_key(F.col("url"))).select(*columns)
    return written(rows.mapInArrow(run, _CAPTURE))


def build_index(captures: DataFrame) -> DataFrame:
    """The index (part, block, first_key, first_id, captures, data) of ``captures``.

    Parts are ranges of (url_key, id), so that many captures of one URL or host
    are spread too.  Without ``data`` it is the sparse directory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        number = 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)))
            for row in rows:
                waiting.append(row)
                if len(waiting) == BLOCK_CAPTURES:
                    yield pack(waiting, number)
                    waiting, number = [], number + 1
        if waiting:
            yield pack(waiting, number)

    def pack(rows: list[tuple], number: int) -> pa.RecordBatch:
        lines = "\n".join(json.dumps(r[1:], separators=(",", ":")) for r in rows)
        block = {"part": [rows[0][0]], "block": [number], "first_key": [rows[0][1]], "first_id": [rows[0][2]], "captures": [len(rows)], "data": [zlib.compress(lines.encode(), 6)]}
        return pa.RecordBatch.from_pydict(block, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("first_id", pa.int64()), ("captures", pa.int32()), ("data", pa.binary())]))

    parts = max(8, -(-captures.count() // PART_CAPTURES))
    sorted_rows = captures.repartitionByRange(parts, "url_key", "id").sortWithinPartitions("url_key", "id")
    rows = sorted_rows.select(F.spark_partition_id().alias("part"), "url_key", "id", "file", "offset", "length")
    return written(rows.mapInArrow(run, "part int, block int, first_key string, first_id long, captures int, data binary"))


def _unpack(data: bytes) -> list[tuple]:
    return [tuple(json.loads(line)) for line in zlib.decompress(data).decode().split("\n")]


def _order(key: str, number: int) -> tuple[bytes, int]:
    return key.encode(), number  # Spark orders strings by their bytes


def _look_up(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Captures of the wanted keys in one part: directory first, then a block."""
    blocks = blocks.sort_values("block")
    directory = [_order(k, i) for k, i in zip(blocks["first_key"], blocks["first_id"])]
    data, found = list(blocks["data"]), []
    asked = sorted(_order(k, i) for k, i in zip(wanted["url_key"], wanted["id"])) if data else []
    # Equal captures may run over a block's end, so the search starts a block early.
    last, rows, keys = -1, [], []
    for key in asked:
        block = max(0, bisect_right(directory, key) - 1)
        first = block
        while first > 0 and directory[first] == key:
            first -= 1
        for number in range(first, block + 1):
            if number != last:
                rows, last = _unpack(data[number]), number
                keys = [_order(r[0], r[1]) for r in rows]
            at = bisect_right(keys, key)
            while at and keys[at - 1] == key:
                at -= 1
                found.append(rows[at])
    kinds = {"url_key": "str", "id": "int64", "file": "str", "offset": "int64", "length": "int64"}
    return pd.DataFrame(found, columns=list(kinds)).astype({k: v for k, v in kinds.items() if v == "int64"})


def look_up(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures (url_key, id, file, offset, length) of ``keys`` (url_key, id).

    The first keys of the parts, one for about ``PART_CAPTURES`` captures, say
    which part a key is searched in; parts are searched where they lie.
    """
    least = F.min(F.struct("first_key", "first_id")).alias("first")
    parts = sorted((_order(*r["first"]), r["part"]) for r in index.groupBy("part").agg(least).collect())
    borders = [p[0] for p in parts]
    numbers = [p[1] for p in parts]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("url_key").to_pylist(), batch.column("id").to_pylist()
            part = [numbers[max(0, bisect_right(borders, _order(k, i)) - 1)] if numbers else 0 for k, i in zip(keys, ids)]
            yield pa.RecordBatch.from_pydict({"url_key": batch.column("url_key"), "id": batch.column("id"), "part": pa.array(part, pa.int32())})

    asked = keys.select("url_key", "id").distinct().mapInArrow(place, "url_key string, id long, part int")
    blocks = index.select("part", "block", "first_key", "first_id", "data")
    return asked.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(_look_up, _CAPTURE)


def read_ranges(captures: DataFrame, folder: str) -> DataFrame:
    """Records at the byte ranges of ``captures``: (page_id, record_type, refers_to, payload_bytes, digest, payload)."""
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))
            for name, ranges in groupby(places, key=lambda p: p[0]):
                with system.open_input_file(f"{base}/{name}") as archive:
                    rows, held = [], 0
                    for _, offset, length in ranges:
                        archive.seek(offset)
                        rows.append(parse_record(zlib.decompress(archive.read(length), 31)))
                        held += rows[-1]["payload_bytes"]
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    near = captures.repartition(max(8, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file").sortWithinPartitions("file", "offset")
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, digest string, payload binary"
    return near.select("file", "offset", "length").mapInArrow(run, schema)
