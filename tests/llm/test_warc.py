import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import catalog, warc

BIG = "<p>é" * 400
ROWS = [
    (1, "http://b.example.com/x", BIG),
    (5, "http://a.example.com/", BIG),
    (3, "https://A.Example.com/y?q=1\r\nX: y", BIG),
    (4, None, "short"),
    (6, "http://c.org", "short"),
    (7, "http://c.org", None),
    (8, "", ""),
    (2, "http://b.example.com/x", "<p>" * 60_000),
    (None, "http://n.net/", BIG),
    (9, "http://d.org/é", "x" * 1000),
    (9, "http://d.org/é", "x" * 1000),
    (10, "http://d.org/é", "x" * 999),
    (11, "http://d.org/é", "x" * 999),
]


def want(rows) -> list[tuple]:
    largest: dict[bytes, int] = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        largest[raw] = max(page if page is not None else -1, largest.get(raw, -1))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and page != largest[raw]
        out.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", largest[raw] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "part", "size"), [(warc.BLOCK_CAPTURES, warc.PART_CAPTURES, warc.ARCHIVE_BYTES), (2, 3, 700)])
def test_query(spark, monkeypatch, block, part, size):
    for name, value in (("BLOCK_CAPTURES", block), ("PART_CAPTURES", part), ("ARCHIVE_BYTES", size)):
        monkeypatch.setattr(warc, name, value)
    pages = spark.createDataFrame([(*r, "d") for r in ROWS], "page_id long, url string, html string, digest string").repartition(2)
    monkeypatch.setattr(catalog, "table", lambda *_: pages)
    got = catalog.op7_warc(spark, "").collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    captures = warc.write_archives(pages, str(tmp_path)).collect()
    names = {r.file for r in captures}
    assert len(captures) == len(ROWS) and names == {p.name for p in tmp_path.iterdir()}
    whole = b"".join(gzip.decompress((tmp_path / n).read_bytes()) for n in names)
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS) and whole.count(b"WARC-Type: revisit") == 3
    for r in captures:
        raw = (tmp_path / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert warc.parse_record(gzip.decompress(raw))["page_id"] in {x[0] for x in ROWS}


def test_damage_is_noticed():
    raw = warc.record(1, "http://a", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), "response", None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    for bad in (raw.replace(b"payload", b"Payload"), raw[:-1], b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_url_keys(spark):
    urls = spark.createDataFrame([("http://B.a.com/x?y",), ("http://a.com",), (None,), ("odd",)], "url string")
    assert [r[0] for r in urls.select(warc.url_key(F.col("url"))).collect()] == ["com,a,b)/x?y", "com,a)", "", ")odd"]


def test_unknown_keys_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(pages, str(tmp_path / "a")))
    keys = spark.createDataFrame([("zz,unknown)", 1), ("", 4), ("", -1), ("com,example,b)/x", 1)], "url_key string, id long")
    assert sorted(r.id for r in warc.look_up(index, keys).collect()) == [1, 4]
    empty = warc.build_index(warc.write_archives(pages.limit(0), str(tmp_path / "b")))
    assert warc.look_up(empty, keys).collect() == []
