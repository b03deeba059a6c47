import random

import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute as brute_components
from test_line_dedup import brute as brute_lines

import corpus_pipeline
from termloom.llm import line_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], list[tuple], list[tuple]]:
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(900)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = ["\n".join(line(rnd.randint(6, 14)) for _ in range(rnd.randint(1, 5))) for _ in range(240)]
    for i in range(0, 240, 6):
        texts[i] = texts[i].replace(" ", " dullard ", 2)
    item = line(18)
    texts[1] += "\n" + item
    texts[3] = item + " " + texts[3]
    texts[5] = "\n".join([line(12), " ".join(item.split()[9:]) + " " + line(4), " ".join(item.split()[:9])])
    base = line(120).split()
    for i in (7, 8, 9):  # one long line each, so that only the shingles join them
        own = list(base)
        own[i] = own[i + 20] = "other"
        texts[i] = " ".join(own)
    texts[10] = texts[13]
    texts[14] = texts[16][:-1] + "x"
    texts += ["", "short", texts[20]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (None, "no id here at all, only words", "en", "s", 1)]
    labels = [(i, int("dullard" in t)) for i, t in enumerate(texts)]
    return rows, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(kept, key=str) == sorted(((r[0], r[1]) for r in corpus()[0] if "dullard" not in (r[1] or "")), key=str)

    lines = corpus_pipeline.drop_lines(spark, clean, folder)
    want = []
    texts = dict(kept)
    for doc_id, _, gone, left in brute_lines(kept):
        own = texts[None if doc_id == "None" else int(doc_id)]
        joined = sum(line_dedup._takes_part(x) for x in (own or "").split("\n"))
        if not gone or len(gone) < joined:
            want.append((doc_id, left if gone else own))
    got = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(((str(d), t) for d, t in got), key=str) == sorted(want, key=str)
    assert lines.where(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).isEmpty()

    once = corpus_pipeline.drop_near_copies(spark, lines, folder)
    components = {d: c for d, _, c in brute_components(got)}
    ids = sorted(str(r.doc_id) for r in once.collect())
    assert once.columns == docs.columns
    assert ids == sorted(d for d, c in components.items() if c == d)
    assert {"7"} == {"7", "8", "9"} & set(ids)

    safe = corpus_pipeline.drop_leaks(spark, once, folder)
    assert safe.columns == docs.columns
    left = {r.doc_id for r in safe.collect()}
    assert {r.doc_id for r in once.collect()} - left == {1, 3, 5}
    assert corpus_pipeline.token_ids(spark, safe, folder).count() == len(left)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert not {1, 3, 5, 8, 9, 0, 6} & {r.doc_id for r in rows.collect()}


def test_documents_keep_the_short_lines_of_their_own(spark, folder):
    head = "A heading that several documents have in common"
    texts = [f"{head}\nroses are red", f"{head}\nviolets are blue\n", f"{head}\n \u3000\n\n", head, "", f"- eggs\n{head}x\n{head}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, folder).collect()}
    want = {0: texts[0], 1: "violets are blue\n", 4: "", 5: "- eggs"}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_repeated_rows_and_empty_table(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 3)] * 3 + [(None, None, None, None, None)] * 2, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == (2 if name == "n-gram Jaccard join" else 5)
        assert stage(spark, docs.limit(0), folder).count() == 0
