"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are dealt into blocks, each with its own hash tables.  A query visits
its bucket and perturbed ones in the order of their estimated success, merges
the candidates of all tables and ranks them by their exact inner product.
A query that meets too few in a block is compared with all of it, and so is
every query where no number of probes reaches the recall on the sample.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of the index, queries in a block of queries.
BLOCK = 16_000
QUERIES = 4_000
#: Vectors that bucket width and number of probes are fitted on at most: those of least hash of vec_id.
SAMPLE = 16_000
TRIALS = 200
TABLES = 8
FUNCTIONS = 16
#: Bucket width, in distances between a query and the last of its neighbours: the distance that
#: this share of the trials outside groups of (near-)copies is within.
WIDTH = 3.0
WITHIN = 0.9
#: Trials whose neighbours lie within this share of the norm, or of that distance, are in such groups.
COPIES = 1e-3
NEAR = 0.1
#: Recall that the number of probes is chosen for, on the sample.
TARGET = 0.96
MOST_PROBES = 8192


@dataclass
class Hashing:
    """Random projections of all tables, and the order of probes."""

    lines: np.ndarray  # tables x functions x dims
    offsets: np.ndarray
    width: float
    mixers: np.ndarray  # tables x functions, to one number a bucket
    probes: np.ndarray  # probes x places: which boundaries, from the nearest on, are crossed
    norm: float
    exact: bool = False  # too little recall at all probes: all vectors are candidates


def probe_order(functions: int, count: int) -> np.ndarray:
    """The ``count`` sets of crossed boundaries of least expected cost, as rows of 0 and 1.

    Boundaries are numbered by their distance; cost is the sum of the expected
    squares.  A set may not cross both boundaries of one function.
    """
    j = np.arange(1, 2 * functions + 1)
    back = 2 * functions + 1 - j
    scale = 4 * (functions + 1) * (functions + 2)
    cost = np.where(j <= functions, j * (j + 1) / scale, 1 - back / (functions + 1) + back * (back + 1) / scale)
    out = [np.zeros(2 * functions, np.int64)]
    heap = [(cost[0], (0,))]
    while heap and len(out) < count:
        total, places = heapq.heappop(heap)
        if all(2 * functions - 1 - p not in places for p in places):
            out.append(np.bincount(places, minlength=2 * functions))
        last = places[-1]
        if last + 1 < 2 * functions:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*places, last + 1)))
    return np.array(out)


def _lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """With one more component, so that all have length ``norm`` and near means a large inner product."""
    rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
    return np.c_[vectors, rest]


class Tables:
    """Hash tables of one block."""

    def __init__(self, hashing: Hashing, vectors: np.ndarray):
        self.hashing, self.vectors = hashing, vectors
        lifted = _lifted(vectors, hashing.norm)
        self.sorted = []
        for table in range(len(hashing.lines)):
            keys = self._keys(np.floor(self._places(lifted, table)), table)
            order = np.argsort(keys, kind="stable")
            self.sorted.append((keys[order], order))

    def _places(self, points: np.ndarray, table: int) -> np.ndarray:
        h = self.hashing
        return (points @ h.lines[table].T + h.offsets[table]) / h.width

    def _keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        return (cells.astype(np.int64).view(np.uint64) * self.hashing.mixers[table]).sum(1, dtype=np.uint64)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Which vectors (columns) each query (rows) meets in its probes."""
        h = self.hashing
        if h.exact:
            return np.ones((len(queries), len(self.vectors)), bool)
        seen = np.zeros((len(queries), len(self.vectors)), bool)
        points = np.c_[queries, np.zeros(len(queries))]
        for table, (keys, order) in enumerate(self.sorted):
            places = self._places(points, table)
            cells = np.floor(places)
            inside = places - cells
            # Distances to the lower and the upper boundary of each function.
            distance = np.c_[inside, 1 - inside]
            nearest = np.argsort(distance, axis=1, kind="stable")
            step = np.concatenate([-h.mixers[table].view(np.int64), h.mixers[table].view(np.int64)])[nearest]
            probed = self._keys(cells, table)[:, None] + (step @ h.probes.T).view(np.uint64)
            low = np.searchsorted(keys, probed.ravel(), "left")
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == probed.ravel())
            low = low[hit]
            counts = np.searchsorted(keys, probed.ravel()[hit], "right") - low
            ends = np.cumsum(counts)
            rows = np.repeat(hit // probed.shape[1], counts)
            seen[rows, order[np.repeat(low - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]] = True
        return seen


def fit(sample: np.ndarray, norm: float, neighbours: int, tables: int = TABLES, functions: int = FUNCTIONS, seed: int = 7) -> Hashing:
    """Bucket width from the sample's neighbour distances, probes from its recall.

    Groups of copies, found whatever the width, count for neither.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1] + 1
    trials = sample[:TRIALS]
    products = trials @ sample.T
    products[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    k = min(neighbours, max(1, len(sample) - 1))
    top = np.argpartition(-products, k - 1, axis=1)[:, :k]
    reached = np.take_along_axis(products, top, 1).min(1)
    reached[~np.isfinite(reached)] = 0
    distance = np.sqrt(np.maximum((trials**2).sum(1) + norm**2 - 2 * reached, 0))
    apart = distance[distance > COPIES * norm]
    near = np.quantile(apart, WITHIN) if len(apart) else norm
    far = distance > NEAR * near if len(apart) else np.ones(len(trials), bool)
    hashing = Hashing(
        rng.standard_normal((tables, functions, dims)),
        np.zeros((tables, functions)),
        WIDTH * float(near),
        rng.integers(1, 2**63, (tables, functions), np.int64).view(np.uint64) | np.uint64(1),
        np.zeros((1, 2 * functions), np.int64),
        norm,
    )
    hashing.offsets = rng.random((tables, functions)) * hashing.width
    order = probe_order(functions, MOST_PROBES)
    index, count = Tables(hashing, sample), 32
    while True:
        hashing.probes = order[:count]
        recall = np.take_along_axis(index.candidates(trials[far]), top[far], 1).mean()
        hashing.exact = bool(recall < TARGET and count >= len(order))
        if recall >= TARGET or hashing.exact:
            return hashing
        count += count // 4


def _search(hashing: Hashing, neighbours: int, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The nearest candidates of each query in one block; of all of it where a query meets too few."""
    found = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(block):
        block = block.sort_values("vec_id")
        ids = block["vec_id"].to_numpy()
        vectors = np.stack(block["vector"].to_numpy())
        asked = np.stack(queries["vector"].to_numpy())
        names = queries["vec_id"].to_numpy()
        tables = Tables(hashing, vectors)
        for at in range(0, len(asked), 128):
            for i, seen in enumerate(tables.candidates(asked[at : at + 128]), at):
                near = np.flatnonzero(seen & (ids != names[i]))
                if len(near) < neighbours:
                    near = np.flatnonzero(ids != names[i])
                # Summed row by row, so that equal vectors have equal scores.
                scores = (vectors[near] * asked[i]).sum(1)
                best = np.lexsort((ids[near], -scores))[:neighbours] if len(near) <= 4 * neighbours else _best(scores, neighbours)
                found["query_id"].append(np.full(len(best), names[i]))
                found["vec_id"].append(ids[near[best]])
                found["score"].append(scores[best])
    return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, float if k == "score" else np.int64) for k, v in found.items()})


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest; of equal ones the first, as ids ascend."""
    limit = np.partition(scores, len(scores) - count)[len(scores) - count]
    enough = np.flatnonzero(scores >= limit)
    return enough[np.argsort(-scores[enough], kind="stable")][:count]


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part.

    Null ids and vectors that are null, zero, or hold null or non-finite
    components are left out, and so are those whose length is not the most
    common one.  Of rows that repeat a vec_id the least vector counts.
    """
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    lengths = good.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    good = good.where(F.size("vector") == (lengths[0]["dims"] if lengths else 0))
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(rows: DataFrame, is_query, neighbours: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query, by inner product.

    ``is_query`` is a condition on vec_id.  A query is no candidate of its own;
    equal scores are ranked by vec_id.
    """
    good = valid_vectors(rows)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    count, most = good.agg(F.count(F.lit(1)), F.max(squares)).first()
    schema = "query_id long, vec_id long, score double"
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column(0)
    dims = len(sample[0])
    flat = sample.combine_chunks().flatten().to_numpy().reshape(-1, dims)
    hashing = fit(flat, float(np.sqrt(most)), neighbours)
    queries = good.where(is_query)
    blocks = -(-count // BLOCK)
    asked = max(1, -(-queries.count() // QUERIES))
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = good.withColumn("block", number(blocks)).withColumn("asked", every(asked))
    spread = queries.select(F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector")).withColumn("asked", number(asked)).withColumn("block", every(blocks))
    shared = rows.sparkSession.sparkContext.broadcast(vars(hashing))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(Hashing(**shared.value), neighbours, left, right)

    found = spread.groupBy("block", "asked").cogroup(dealt.groupBy("block", "asked")).applyInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")
