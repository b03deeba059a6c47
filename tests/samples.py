"""Small inputs with known answers."""

import math
import re

from pyspark.sql import types as T

from termloom.plans.catalog import LetterModel

DOC = T.StructType(
    [
        T.StructField("doc_key", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

SEEDS = [
    ("rust-notes", "Rust on old gates",
     "Rust eats the hinge first and then the bar. For safety we scrape the rust away, oil the hinge "
     "and paint the whole gate; the safety of the yard depends on the latch, and a plain language of "
     "signs tells visitors to close it.", "https://yard.example/gates"),
    ("herb-garden", "Herbs and a learning gardener",
     "A machine learning to water herbs needs a patient teacher. The thyme wants sand, the mint wants "
     "shade, and the language of leaves says the rest. Building a raised bed takes one morning.",
     "https://yard.example/herbs"),
    ("library-search", "A search in the village library",
     "The search begins with a drawer of cards. Each card lists a word and the shelves that hold it, "
     "so the search for two words compares two cards. The librarian ranks the finds by hand.",
     "https://library.example/cards"),
    ("vector-atlas", "An atlas of arrows",
     "Every vector in the atlas is an arrow from the harbour to an island. Vector databases of the "
     "sailors were notebooks: similar arrows lay on the same page, and a search took an evening.", None),
    ("web-kitchen", "Kitchens that share a web of pipes",
     "The web of pipes under the street joins three kitchens. One pipe shows rust, one leaks, and one "
     "is new. Building codes ask for copper, and the cooks ask for warm water.", None),
]


def documents(spark, rows):
    full = [(n, *r, *([None] * (4 - len(r)))) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, DOC)


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text) if len(w.encode()) < 40]


def bm25(rows, query, fields=(1, 2)):
    """Plain-Python scores {id: score} of a bag of words."""
    scores = {}
    for f in fields:
        texts = [words(r[f]) for r in rows]
        average = sum(map(len, texts)) / len(texts)
        for q in words(query):
            df = sum(q in t for t in texts)
            if not df:
                continue
            idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
            for row, t in zip(rows, texts):
                tf = t.count(q)
                if tf:
                    part = idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
                    scores[row[0]] = scores.get(row[0], 0.0) + part
    return scores


class Counting(LetterModel):
    def embed(self, texts):
        assert 0 < len(texts) <= 100
        return super().embed(texts)


class Failing(LetterModel):
    def embed(self, texts):
        raise RuntimeError("model is down")


class FailingOn(LetterModel):
    """Fails every call that holds a text with ``word``."""

    def __init__(self, word):
        self.word = word

    def embed(self, texts):
        if any(self.word in text for text in texts):
            raise RuntimeError(f"no vector for {self.word}")
        return super().embed(texts)
