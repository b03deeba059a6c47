"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over its
words; the document is toxic unless every sentence is clean (noisy-or).  Only
document labels are needed to train, and the sentence scores then show where
the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.common import slices

#: Labelled rows that a model is fitted on at most: those of least hash of doc_id.
SAMPLE_ROWS = 10_000
#: Longer texts are scored, but no model is fitted on them; so the sample's size is bounded.
LONGEST_TEXT = 20_000
#: A word must be in so many sampled documents to get a weight.
LEAST_DOCUMENTS = 5
#: Standard errors by which its share of toxic documents must exceed that of clean ones.
CLEAR = 4.0
ROUNDS = 300
#: Words that a task remembers the value of before it starts afresh.
REMEMBERED_WORDS = 200_000
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
_ZEROS = (0.0,) * 4


@dataclass
class Model:
    """Weight of each telling feature of a word, and the sentence bias."""

    weights: dict[str, float]
    bias: float


def _sentences(tokens: list[str], known: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """(sentence, word number) of the known words in sentences, each once; number of sentences."""
    sentence, at, words = 0, [], []
    filled = False
    for token in tokens:
        if token in _ENDS:
            sentence += filled
            filled = False
        else:
            filled = True
            number = known.get(token)
            if number is not None:
                at.append(sentence)
                words.append(number)
    pairs = np.unique(np.array(at, np.int64) << 32 | np.array(words, np.int64)) if at else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF, sentence + filled


def features(word: str) -> set[str]:
    """The word itself and its beginnings of 3 to 5 letters, which inflected forms share."""
    return {word, word[:3] + "-", word[:4] + "-", word[:5] + "-"}


def _words(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower())) - _ENDS


def _telling(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Features that toxic bags hold clearly more often than clean ones."""
    counts: tuple[dict[str, int], dict[str, int]] = {}, {}
    for text, label in zip(texts, toxic):
        own = counts[int(label)]
        for name in set().union(*map(features, _words(text))):
            own[name] = own.get(name, 0) + 1
    # Only what toxic bags hold can tell them apart.
    names = sorted(counts[1])
    clean, bad = (np.array([some.get(n, 0) for n in names], float) for some in counts)
    n1 = toxic.sum()
    n0 = len(toxic) - n1
    share = (clean + bad) / len(toxic)
    spread = np.sqrt(np.maximum(share * (1 - share), 1 / len(toxic)) * (1 / n1 + 1 / n0))
    enough = min(LEAST_DOCUMENTS, len(toxic))
    return [names[i] for i in np.flatnonzero((clean + bad >= enough) & ((bad / n1 - clean / n0) / spread > CLEAR))]


def fit(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, penalty: float = 1e-5) -> Model:
    """Least noisy-or log loss over the bags, by Adam on the whole sample.

    Without both classes nothing can be learnt: the model then scores 0.
    """
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return Model({}, -np.inf)
    number = {name: i for i, name in enumerate(_telling(texts, toxic))}
    words: dict[str, int] = {}
    parts: list[tuple[int, int]] = []
    for text in texts:
        for word in sorted(_words(text).difference(words)):
            if own := [number[f] for f in sorted(features(word)) if f in number]:
                parts += [(len(words), f) for f in own]
                words[word] = len(words)
    part_word, part_feature = np.array(parts, np.int64).reshape(-1, 2).T
    sentence_of, word_of, bag_of, total = [], [], [], 0
    for bag, text in enumerate(texts):
        s, w, n = _sentences(_TOKEN.findall(text.lower()), words)
        sentence_of.append(s + total)
        word_of.append(w)
        bag_of.append(np.full(n, bag))
        total += n
    sentence_of, word_of, bag_of = (np.concatenate(x) for x in (sentence_of, word_of, bag_of))
    theta = np.zeros(len(number) + 1)
    theta[-1] = np.log(toxic.mean() / max(1.0, total / len(texts)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        values = np.bincount(part_word, theta[part_feature], len(words))
        z = theta[-1] + np.bincount(sentence_of, values[word_of], total)
        amount = np.bincount(bag_of, np.logaddexp(0, z), len(texts))
        grown = np.where(toxic, -1 / np.expm1(np.clip(amount, 1e-9, 500)), 1.0)
        dz = grown[bag_of] / (1 + np.exp(-z)) / len(texts)
        by_word = np.bincount(word_of, dz[sentence_of], len(words))
        gradient = np.append(np.bincount(part_feature, by_word[part_word], len(number)), dz.sum())
        gradient[:-1] += penalty * theta[:-1]
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({name: float(theta[i]) for name, i in number.items()}, float(theta[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample_rows`` labelled documents, those of least hash of doc_id.

    Texts of more than ``LONGEST_TEXT`` characters are left out of them.
    Labels of one doc_id count as toxic if any does; null labels and ids are left out.
    """
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST_TEXT)
    # One text for each id, whatever the number of its rows, or a repeated id would fill the sample.
    found = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic")
    return found.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled documents; the sample is the only text the driver sees."""
    rows = training_rows(docs, labels, sample_rows).toArrow().sort_by("doc_id").to_pydict()
    return fit([t or "" for t in rows["text"]], np.array(rows["toxic"], float) > 0)


class Scorer:
    """Scores texts; remembers which words have a value."""

    def __init__(self, model: Model):
        self.model = model
        self.numbers: dict[str, int | None] = {}
        self.values: list[float] = []

    def _learn(self, words: set[str]) -> None:
        if len(self.numbers) > REMEMBERED_WORDS:
            self.numbers, self.values = {}, []
            return self._learn(words)
        weight = self.model.weights.get
        for word in words.difference(self.numbers):
            value = sum(map(weight, features(word), _ZEROS))
            self.numbers[word] = len(self.values) if value else None
            if value:
                self.values.append(value)

    def score(self, text: str) -> tuple[float, np.ndarray]:
        """Noisy-or score of a text, and the log odds of its sentences."""
        tokens = _TOKEN.findall(text.lower())
        self._learn(set(tokens))
        sentence, words, count = _sentences(tokens, self.numbers)
        if not count or self.model.bias == -np.inf:
            return 0.0, np.full(count, -np.inf)
        values = np.fromiter(map(self.values.__getitem__, words.tolist()), float, len(words))
        z = self.model.bias + np.bincount(sentence, values, count)
        return float(-np.expm1(-np.logaddexp(0, z).sum())), z


def score(docs: DataFrame, model: Model, worst: int = 3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``n_offending`` and ``offending``.

    ``n_offending`` counts the sentences that are toxic by themselves (0.5 or
    more); ``offending`` names the ``worst`` of them as (sentence, score).
    Null and empty texts score 0.  All other columns pass through, text included.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    added = ("score", "n_offending", "offending")
    kept = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in kept]
    found = pa.struct([("sentence", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            for some in slices(batch, "text"):
                scores, counts, places = [], [], []
                for text in some.column("text").to_pylist():
                    value, z = scorer.score(text or "")
                    bad = np.flatnonzero(z >= 0)
                    scores.append(value)
                    counts.append(len(bad))
                    top = bad[np.argsort(-z[bad], kind="stable")[:worst]]
                    places.append([{"sentence": int(i), "score": float(1 / (1 + np.exp(-z[i])))} for i in top])
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(n) for n in names), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(places, pa.list_(found))],
                    [*names, *added],
                )

    schema = T.StructType(
        [
            *kept,
            T.StructField("score", T.DoubleType()),
            T.StructField("n_offending", T.LongType()),
            T.StructField("offending", T.ArrayType(T.StructType([T.StructField("sentence", T.LongType()), T.StructField("score", T.DoubleType())]))),
        ]
    )
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
