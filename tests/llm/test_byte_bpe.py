import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from termloom.llm import byte_bpe
from termloom.llm.catalog import RANKS, token_digests

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts() -> list[str]:
    rnd = random.Random(1)
    odd = ["", " ", "x" * 3000, "ab" * 900, "aaab" * 300, " " * 700, "\n" * 90 + "a", "é" * 400, "日本語" * 90, "<|endoftext|>"]
    mixed = ["".join(rnd.choice("aehtion srl'é1 \n.-日") for _ in range(rnd.randint(0, 900))) for _ in range(80)]
    return odd + mixed + ["".join(rnd.choice("abcdetion") for _ in range(2000))]


def test_ids_are_those_of_the_library(vocab, reference):
    encoder = byte_bpe.Encoder(vocab, public_tokenizers.PATTERN)
    got = encoder.encode(texts())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts()]


def test_forgetting_and_long_texts_change_nothing(vocab, monkeypatch):
    whole = byte_bpe.Encoder(vocab, public_tokenizers.PATTERN).encode(texts())
    monkeypatch.setattr(byte_bpe, "REMEMBERED_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 50)
    monkeypatch.setattr(byte_bpe, "WORDS_AT_ONCE", 7)
    assert byte_bpe.Encoder(vocab, public_tokenizers.PATTERN).encode(texts()) == whole


def test_query_rows(spark, vocab, reference):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "same", "x"), (7, None, None), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = token_digests(docs, vocab).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(d), len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t, _ in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_empty_table(spark, vocab):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_digests(docs, vocab).collect() == []
