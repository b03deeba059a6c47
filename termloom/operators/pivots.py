"""Which vectors can be among the nearest of which queries, by distances to pivots.

Queries are grouped around centres and vectors around pivots.  The distances of
a pivot's closest vectors bound how far the k-th neighbour of any query of a
group can be; a vector that the triangle inequality puts further away than
that never meets the group.  Directions are compared as points on a sphere, on
which the distance of two points orders them as their cosine does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Pivots of the vectors at most, and distances to them that are brought to the driver at most.
MOST_PIVOTS = 256
MOST_DISTANCES = 2_000_000
# Scores are rounded to 6 digits: cosines this close may tie.
ROUNDING = 2e-6
# Computed distances are off by less than this.
SLACK = 1e-7


def points(matrix: np.ndarray, zero_side: int) -> np.ndarray:
    """Rows as points of the sphere.

    A row of zeros has cosine 0 with everything, so it goes to a direction of
    its own: one for zero vectors (side 0) and one for zero queries (side 1).
    """
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    out = np.zeros((len(matrix), matrix.shape[1] + 2))
    np.divide(matrix, length, out=out[:, :-2], where=length > 0)
    out[length[:, 0] == 0, matrix.shape[1] + zero_side] = 1.0
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points of ``a`` from all of ``b``."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def rows_of(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in chunks]
    return np.concatenate([*flat, np.empty(0)]).reshape(-1, dims)


def some_points(rows: DataFrame, column: str, dims: int, most: int, zero_side: int) -> np.ndarray:
    """Up to ``most`` rows, those of least hash, as points."""
    sample = rows.orderBy(F.xxhash64(column), column).limit(most).select(column).toArrow()
    return points(rows_of(sample.column(column), dims), zero_side)


def near_pivots(rows: DataFrame, column: str, pivots: np.ndarray, dims: int, zero_side: int) -> DataFrame:
    """``rows`` with the number of the nearest pivot and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(points(rows_of(batch.column(column), dims), zero_side), shared.value)
            nearest = far.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            more = [pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(nearest)), nearest])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "pivot", "far"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(assign, f"{types}, pivot int, far double")


def admitted(
    closest: list[np.ndarray], between: np.ndarray, reach: np.ndarray, k: int
) -> list[tuple[int, int, float, float]]:
    """(group, pivot, low, high): distances from the pivot at which a vector can be a neighbour in the group.

    ``closest`` are the least distances of each pivot's vectors, ``between`` those
    of group centres and pivots, ``reach`` the largest of each group's queries.
    """
    out = []
    for group, to_pivots in enumerate(between):
        at_most = np.concatenate([reach[group] + d + c for d, c in zip(to_pivots, closest)] + [np.empty(0)])
        kth = np.partition(at_most, k - 1)[k - 1] if len(at_most) >= k else 2.0
        kth = math.sqrt(min(kth, 2.0) ** 2 + 2 * ROUNDING) + SLACK
        for pivot, d in enumerate(to_pivots):
            low, high = d - reach[group] - kth - SLACK, d + reach[group] + kth + SLACK
            if len(closest[pivot]):
                out.append((group, pivot, float(low), float(high)))
    return out


@dataclass(frozen=True)
class Admission:
    """Centres of the groups of queries, pivots of the vectors, and which vectors a group admits.

    A vector meets ``group`` if its distance from its ``pivot`` lies between
    ``low[group, pivot]`` and ``high[group, pivot]``.
    """

    pivots: np.ndarray
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def empty(self) -> bool:
        return not len(self.pivots) or not len(self.centres)


def admission(vectors: DataFrame, queries: DataFrame, k: int, dims: int, n_queries: int, per_group: int) -> Admission:
    """Groups for ``queries`` (qid, query_embedding) and what of ``vectors`` (id, embedding) each admits.

    Nothing is written: a row's pivot costs less to find again than to keep.
    """
    n_pivots = max(1, min(MOST_PIVOTS, MOST_DISTANCES // k))
    pivots = some_points(vectors, "embedding", dims, n_pivots, 0)
    n_groups = max(1, min(MOST_PIVOTS, -(-n_queries // per_group)))
    centres = some_points(queries, "query_embedding", dims, n_groups, 1)
    low, high = np.full((len(centres), len(pivots)), np.inf), np.full((len(centres), len(pivots)), -np.inf)
    if not len(pivots) or not len(centres):
        return Admission(pivots, centres, low, high)
    placed = near_pivots(vectors.select("embedding"), "embedding", pivots, dims, 0)
    asked = near_pivots(queries.select("query_embedding"), "query_embedding", centres, dims, 1)
    order = Window.partitionBy("pivot").orderBy("far")
    least = placed.select("pivot", "far", F.row_number().over(order).alias("n")).where(F.col("n") <= k).toArrow()
    owner, far = least.column("pivot").to_numpy(), least.column("far").to_numpy()
    closest = [np.sort(far[owner == p]) for p in range(len(pivots))]
    widest = {r["pivot"]: r["far"] for r in asked.groupBy("pivot").agg(F.max("far").alias("far")).collect()}
    reach = np.array([widest.get(g, 0.0) for g in range(len(centres))])
    for group, pivot, least_far, most_far in admitted(closest, distances(centres, pivots), reach, k):
        if group in widest:
            low[group, pivot], high[group, pivot] = least_far, most_far
    return Admission(pivots, centres, low, high)


def meetings(vectors: DataFrame, queries: DataFrame, k: int, dims: int, n_queries: int, per_group: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the ``group`` in which they meet; vectors once for each group that admits them.

    ``vectors`` has (id, embedding) and ``queries`` (qid, query_embedding).  This
    lists what :func:`~termloom.operators.knn.knn_by_pivots` compares, and has as
    many rows.
    """
    found = admission(vectors, queries, k, dims, n_queries, per_group)
    if found.empty:
        none = F.lit(0)
        return vectors.limit(0).withColumn("group", none), queries.limit(0).withColumn("group", none)
    table = [(int(g), int(p), float(found.low[g, p]), float(found.high[g, p])) for g, p in zip(*np.nonzero(found.low <= found.high))]
    bounds = vectors.sparkSession.createDataFrame(table, "`group` int, pivot int, low double, high double")
    placed = near_pivots(vectors, "embedding", found.pivots, dims, 0)
    asked = near_pivots(queries, "query_embedding", found.centres, dims, 1)
    met = placed.join(F.broadcast(bounds), "pivot").where((F.col("far") >= F.col("low")) & (F.col("far") <= F.col("high")))
    return met.select("id", "embedding", "group"), asked.select("qid", "query_embedding", F.col("pivot").alias("group"))
