import random

import numpy as np
import pytest

from termloom.llm import toxicity


def labelled(n: int) -> tuple[list[str], np.ndarray]:
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            sentences[rnd.randrange(len(sentences))] += " " + rnd.choice(["blockhead", "nitwit", "grubling", "grublet"])
        texts.append(". ".join(sentences))
        marks.append(toxic)
    return texts, np.array(marks)


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*labelled(600))


def test_held_out_accuracy_and_place(model):
    texts, toxic = labelled(900)
    scorer = toxicity.Scorer(model)
    results = [scorer.score(t) for t in texts[600:]]
    assert np.mean([(s >= 0.5) == t for (s, _), t in zip(results, toxic[600:])]) > 0.97
    for text, (value, odds) in zip(texts[600:], results):
        if value >= 0.9:
            assert any(w in text.split(". ")[int(odds.argmax())] for w in ("blockhead", "nitwit", "grubl"))


def test_noisy_or(model):
    value, odds = toxicity.Scorer(model).score("word1 nitwit. word2 word3! grublet")
    assert value == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-odds))))


def test_forgetting_changes_nothing(model, monkeypatch):
    texts, _ = labelled(30)
    scorer = toxicity.Scorer(model)
    want = [scorer.score(t)[0] for t in texts]
    monkeypatch.setattr(toxicity, "REMEMBERED_WORDS", 3)
    scorer = toxicity.Scorer(model)
    assert [scorer.score(t)[0] for t in texts] == want


def test_rows(spark, model):
    rows = [(None, "nitwit", 1.0), (1, None, 2.0), (2, "", 3.0), (3, "... !!", 4.0), (3, "... !!", 4.0), (4, "word5 " * 20_000, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].score >= 0.5 and by_id[None].offending[0].sentence == 0
    assert all(by_id[i].score == 0 for i in (1, 2, 3)) and by_id[4].score < 0.5


def test_training_rows_and_missing_classes(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    rows = {r.text: r.toxic for r in toxicity.training_rows(docs, labels).collect()}
    assert rows == {"text 1": 1, "text 3": 0}
    assert toxicity.training_rows(docs, labels, 1).count() <= 1
    model = toxicity.train(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0] * 21
    assert toxicity.score(docs.limit(0), model).collect() == []
