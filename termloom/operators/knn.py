"""Exact nearest neighbours by cosine similarity, for a table of query vectors.

Scores live in numpy blocks inside a task and are never rows; only the best k
per query leave it.  A few queries are compared with every vector; of many,
groups of near ones are compared with the vectors that can be their neighbours.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.pivots import Admission, admission, near_pivots
from termloom.operators.topk import top_k
from termloom.operators.vectors import check_dims
from termloom.schema import SCORE_DIGITS
from termloom.session import scratch_table, work_folder

# Query sides up to these sizes travel to every task; larger ones are grouped, and
# the vectors travel to them, up to so many values at once.
BROADCAST_QUERIES = 4_096
BROADCAST_VALUES = 4_000_000
BROADCAST_RESULTS = 4_000_000
VALUES_PER_PASS = 16_000_000
QUERIES_PER_BLOCK = 1_024
VECTORS_PER_BLOCK = 4_096
SCORES_PER_STEP = 4_000_000
# Candidates whose exact scores are computed together.
PAIRS_AT_ONCE = 100_000
# A query with more candidates than so many times k gets a bound from the block at hand.
MANY = 8


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero, so their cosine is 0."""
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


class _Best:
    """The best k of everything offered so far, per query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * queries
        self.ids = [np.empty(0, dtype=object)] * queries

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= cut
            scores, ids = scores[near], ids[near]
        scores = np.concatenate([self.scores[q], scores])
        ids = np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def _score_block(best: _Best, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
    step = max(1, SCORES_PER_STEP // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        block = np.round(queries[start : start + step] @ vectors.T, SCORE_DIGITS) + 0.0
        for i, row in enumerate(block):
            best.offer(start + i, row, ids)


def _best_rows(best: _Best, qids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    counts = [len(s) for s in best.scores]
    picked = pa.array(np.repeat(np.arange(len(counts)), counts))
    return pa.RecordBatch.from_arrays(
        [
            qids.take(picked).cast(schema.field(0).type),
            pa.array(np.concatenate([*best.ids, np.empty(0, dtype=object)]), pa.string()),
            pa.array(np.concatenate([*best.scores, np.empty(0)]), pa.float64()),
        ],
        schema=schema,
    )


def _result_schema(queries: DataFrame) -> tuple[str, pa.Schema]:
    kind = queries.schema["qid"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    ddl = f"qid {'string' if kind == 'string' else 'bigint'}, id string, score double"
    return ddl, pa.schema([("qid", arrow), ("id", pa.string()), ("score", pa.float64())])


# Joins index and id into one name; sorts before any character of either.
_SEPARATOR = "\0"


def knn(
    vectors: DataFrame, queries: DataFrame, k: int, dims: int, by_index: bool = False, grouped: bool = False
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` most similar vectors of each query.

    ``vectors`` has (id, embedding), ``queries`` has (qid, query_embedding); both
    are checked against ``dims``.  With ``by_index`` vectors are told apart by
    (index_name, id), and the result names the index too.  ``grouped`` groups the
    queries also when they are few.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if by_index:
        named = vectors.withColumn("id", F.concat_ws(_SEPARATOR, "index_name", "id"))
        found = knn(named, queries, k, dims, grouped=grouped)
        parts = F.split("id", _SEPARATOR, 2)
        return found.withColumns({"index_name": parts[0], "id": parts[1]})
    vectors = check_dims(vectors.select("id", "embedding"), dims)
    queries = check_dims(queries.select("qid", "query_embedding"), dims, "query_embedding")
    n_queries = queries.select("qid").count()
    small = not grouped and (
        n_queries <= BROADCAST_QUERIES
        and n_queries * dims <= BROADCAST_VALUES
        and n_queries * k <= BROADCAST_RESULTS
    )
    found = _by_broadcast(vectors, queries, k, dims) if small else knn_by_pivots(
        vectors, queries, k, dims, n_queries
    )
    return top_k(found, ["qid"], [F.desc("score"), F.asc("id")], k)


def _by_broadcast(vectors: DataFrame, queries: DataFrame, k: int, dims: int) -> DataFrame:
    ddl, schema = _result_schema(queries)
    table = queries.toArrow().combine_chunks()
    qids = pa.concat_arrays(table["qid"].chunks) if table.num_rows else pa.array([], pa.int64())
    matrix = (
        _unit_rows(_matrix(pa.concat_arrays(table["query_embedding"].chunks), dims))
        if table.num_rows
        else np.empty((0, dims))
    )
    shared = vectors.sparkSession.sparkContext.broadcast((qids, matrix))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shared.value
        best = _Best(len(matrix), k)
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column("id").to_pylist(), dtype=object)
                _score_block(best, matrix, _unit_rows(_matrix(batch.column("embedding"), dims)), ids)
        yield _best_rows(best, qids, schema)

    return vectors.mapInArrow(nearest, ddl)


def knn_by_pivots(vectors: DataFrame, queries: DataFrame, k: int, dims: int, n_queries: int) -> DataFrame:
    """The best k of each query and pass, where only vectors that its group of queries admits are compared with it.

    Queries lie by group in partitions of even size, and vectors are sent to all
    of them, part by part, so no (group, vector) pair becomes a row.  Each pass
    leaves k rows a query; no more than the vectors of one are at the driver.
    """
    ddl, schema = _result_schema(queries)
    spark = vectors.sparkSession
    found = admission(vectors, queries, k, dims, n_queries, QUERIES_PER_BLOCK)
    if found.empty:
        return spark.createDataFrame([], ddl)
    passes = max(1, -(-vectors.count() * dims // VALUES_PER_PASS))
    asked = near_pivots(queries, "query_embedding", found.centres, dims, 1)
    asked = asked.select("qid", "query_embedding", F.col("pivot").alias("group"))
    tasks = max(1, min(-(-n_queries // QUERIES_PER_BLOCK), 2 * spark.sparkContext.defaultParallelism))
    # By range, so that a group of many queries is cut; what lies side by side is of one group.
    spread = F.xxhash64("qid", "query_embedding")
    asked = asked.repartitionByRange(tasks, "group", spread).sortWithinPartitions("group")
    placed = near_pivots(vectors, "embedding", found.pivots, dims, 0)
    if passes == 1:
        return asked.mapInArrow(_nearest(_shared(placed, found, dims), k, dims, schema), ddl)
    asked = scratch_table(asked)
    placed = scratch_table(placed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(passes)).cast("int")))
    folder = f"{work_folder(spark)}/scratch-{uuid.uuid4().hex}"
    for number in range(passes):
        shared = _shared(placed.where(F.col("part") == number).drop("part"), found, dims)
        asked.mapInArrow(_nearest(shared, k, dims, schema), ddl).write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(ddl).parquet(folder)


def _shared(placed: DataFrame, found: Admission, dims: int) -> Broadcast:
    """Vectors in the order of their ids, sent to all tasks, with what says which groups admit them."""
    table = placed.toArrow().combine_chunks()
    table = table.take(pc.sort_indices(table["id"], null_placement="at_start")).combine_chunks()
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in table["embedding"].chunks]
    matrix = np.concatenate([*flat, np.empty(0, np.float32)]).reshape(-1, dims) if flat else np.empty((0, dims), np.float32)
    ids = pa.concat_arrays(table["id"].chunks) if table.num_rows else pa.array([], pa.string())
    columns = [table[c].to_numpy() for c in ("pivot", "far")]
    return placed.sparkSession.sparkContext.broadcast((ids, matrix, *columns, found.low, found.high))


def _nearest(shared: Broadcast, k: int, dims: int, schema: pa.Schema):
    """A function for ``mapInArrow`` on queries that lie by group: their best k of the ``shared`` vectors."""
    queries_at_once, vectors_at_once = QUERIES_PER_BLOCK, VECTORS_PER_BLOCK
    # What a cosine of unit rows in single precision, and a rounded score, can be off by.
    off = np.float32((dims + 8) * 2.4e-7 + 2 * 10.0**-SCORE_DIGITS)

    def block(queries: np.ndarray, places: np.ndarray, matrix: np.ndarray) -> _Nearest:
        best, near = _Nearest(len(queries), k), queries.astype(np.float32)
        for at in range(0, len(places), vectors_at_once):
            place = places[at : at + vectors_at_once]
            # Places without a gap are a slice, which is not copied.
            whole = len(place) == place[-1] - place[0] + 1
            rows = _unit_rows((matrix[place[0] : place[-1] + 1] if whole else matrix[place]).astype(np.float64))
            scores = near @ rows.astype(np.float32).T
            q, v = best.candidates(scores, off)
            for start in range(0, len(q), PAIRS_AT_ONCE):
                a, b = q[start : start + PAIRS_AT_ONCE], v[start : start + PAIRS_AT_ONCE]
                best.offer(a, place[b], np.round(np.einsum("ij,ij->i", queries[a], rows[b]), SCORE_DIGITS) + 0.0)
        best.settle()
        return best

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, pivot, far, low, high = shared.value
        for batch in batches:
            group = batch.column("group").to_numpy()
            queries = _unit_rows(_matrix(batch.column("query_embedding"), dims))
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for first, last in zip(edges, edges[1:]):
                g = group[first]
                places = np.flatnonzero((far >= low[g][pivot]) & (far <= high[g][pivot]))
                for at in range(first, last, queries_at_once):
                    size = min(queries_at_once, last - at)
                    best = block(queries[at : at + size], places, matrix)
                    qids = batch.column("qid").slice(at, size)
                    columns = [qids.take(pa.array(best.query)).cast(schema.field(0).type), ids.take(pa.array(best.place)).cast(pa.string()), pa.array(best.score)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return nearest


class _Nearest:
    """The best k places of each query, ties to the smaller place, as flat arrays."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -2.0)
        self.query, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple] = []
        self.rows = 0

    def candidates(self, scores: np.ndarray, off: np.float32) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) of scores that may reach the floor."""
        width = scores.shape[1]
        enough = scores >= (self.floor.astype(np.float32) - off)[:, None]
        if width > self.k and np.count_nonzero(enough) > len(scores) * self.k:
            many = np.flatnonzero(enough.sum(axis=1) > MANY * self.k)
            kth = np.partition(scores[many], width - self.k, axis=1)[:, width - self.k]
            enough[many] &= scores[many] >= (kth - 2 * off)[:, None]
        at = np.flatnonzero(enough.reshape(-1))
        return at // width, at % width

    def offer(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((query, place, score))
        self.rows += len(query)
        if 2 * self.rows >= len(self.floor) * self.k:
            self.settle()

    def settle(self) -> None:
        """Keeps the best k out of what was kept and what was offered since, and raises the floors."""
        parts = zip((self.query, self.place, self.score), *self.waiting)
        query, place, score = (np.concatenate(part) for part in parts)
        order = np.lexsort((place, -score, query))
        query, place, score = query[order], place[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.floor[query[last]] = score[last]
        self.query, self.place, self.score = (x[nth < self.k] for x in (query, place, score))
        self.waiting, self.rows = [], 0
