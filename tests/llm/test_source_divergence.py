import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from termloom.llm import catalog, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, most=200):
    docs = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    holders = defaultdict(Counter)
    for lang, _, terms in docs:
        holders[lang].update(set(terms))
    keep = {lang: {t for t, n in c.items() if n >= 3} for lang, c in holders.items()}
    count = defaultdict(Counter)
    for lang, source, terms in docs:
        own = [t for t in terms if t in keep[lang]]
        count[lang, source].update(own)
        count[lang, None].update(own)
    share = {k: lambda t, c=c, v=len(keep[k[0]]): 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for k, c in count.items()}
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang, source in share:
        if source is None:
            continue
        p = share[lang, source]
        others = [s for la, s in share if la == lang and s not in (None, source)]
        pairs = [(sum(f(p(t), share[lang, s](t)) for t in keep[lang]), s) for s in others]
        own = [t for t in keep[lang] if count[lang, source][t] and p(t) > share[lang, None](t)]
        terms = [(f(p(t), share[lang, None](t)), t) for t in own]
        for part, found, last in (("pair", pairs, None), ("term", terms, most)):
            found.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, value, n) for n, (value, item) in enumerate(found[:last], 1)]
    return sorted(out)


def some_rows(seed, n, sources):
    rnd = random.Random(seed)
    words = ["a", "É", "é", "Zoo", "zoo", "x1y", "l'eau", "naïve", "日本", "\U0001f600z", "_u", "K"] + [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "fr", None]), f"s{int(rnd.random() ** 3 * sources)}", "t", 1) for i in range(n)]
    rows += [(None, None, None, None, "t", 1), (1, "", "de", "s1", "t", 1), (2, "unique words", "de", "s2", "t", 1), (3, "alone " * 9, "it", "s0", "t", 1)]
    return rows + rows[:5]


@pytest.mark.parametrize("group_block,term_block,held", [(32, 8192, 300_000), (3, 4, 50)])
def test_audit_equals_brute_force(spark, monkeypatch, group_block, term_block, held):
    monkeypatch.setattr(source_divergence, "GROUP_BLOCK", group_block)
    monkeypatch.setattr(source_divergence, "TERM_BLOCK", term_block)
    monkeypatch.setattr(source_divergence, "HELD", held)
    rows = some_rows(group_block, 150, 12)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = source_divergence.audit(docs, 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7)


def test_shuffled_groups_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 0)
    rows = some_rows(5, 60, 4)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, source_divergence.audit(docs).collect())) == brute(rows)
    assert source_divergence.audit(docs.where(F.lit(False))).collect() == []


def test_shares_of_very_large_counts(spark):
    cases = [(0, 1), (8_999_999_999, 9_000_000_001), (9_000_000_000, 9_100_000_000), (5 * 10**17, 9 * 10**17)]
    rows = spark.createDataFrame(cases, "n long, total long")
    got = rows.select("n", "total", source_divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // total for n, total in cases]


def test_sql(spark, tmp_path):
    rows = some_rows(8, 80, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = connection.execute(f"SELECT lang, source, part, item, value, rank FROM ({catalog.ORACLES['op13_source_divergence']})").fetchall()
    assert sorted(want) == brute(rows)
    assert sorted(map(tuple, catalog.op13_source_divergence(spark, str(tmp_path)).collect())) == brute(rows)
