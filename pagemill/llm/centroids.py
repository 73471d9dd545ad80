"""Centroid clustering of integer vectors with Elkan's bounds.

Between rounds every vector keeps its cluster, an upper bound of the distance to its centroid and a lower bound of the
distance to each. A round moves the bounds by how far the centroids moved and computes a distance only where a bound does
not tell that it is larger. Bounds are rounded outward and only strictly larger distances are skipped, so that ties are
always computed; distances are exact in 64-bit integers. Tasks read stored vectors in batches; the driver holds the
centroids and their cluster's component sums, whose number is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import Scratch

#: Squared distances of components within this bound fit 64 bits for up to 64 components.
LARGEST = 2**27
#: Relative outward rounding of bounds, far above the error of a square root of a 64-bit integer.
SLACK = 1e-12


def up(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def down(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    return ((x - y) ** 2).sum(-1)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number) with new bounds, and the number of distances computed.

    A centroid is skipped if its lower bound, or half the distance between it and the vector's own one, is above the upper
    bound: then it is strictly farther than the own one.
    """
    n, k = lower.shape
    half = down(squared(centroids[:, None], centroids[None])) / 2
    np.fill_diagonal(half, np.inf)
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    open_ = np.flatnonzero(upper >= half.min(1)[own])
    exact = squared(x[open_], centroids[own[open_]])
    upper[open_] = up(exact)
    lower[open_, own[open_]] = down(exact)
    near = (lower[open_] <= upper[open_, None]) & (half[own[open_]] <= upper[open_, None])
    best, count = own[open_], len(open_)
    for j in range(k):
        at = np.flatnonzero(near[:, j] & (own[open_] != j))
        d2 = squared(x[open_[at]], centroids[j])
        count += len(at)
        lower[open_[at], j] = down(d2)
        wins = (d2 < exact[at]) | (d2 == exact[at]) & (j < best[at])
        exact[at[wins]], best[at[wins]] = d2[wins], j
    own[open_], upper[open_] = best, up(exact)
    return own, upper, lower, count


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _rows(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(matrix.reshape(-1), kind))


def _step(centroids: np.ndarray, moved: np.ndarray):
    """A round over batches: bounds follow the centroids' moves, then vectors are assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        for batch in batches:
            x = _matrix(_column(batch, "v"), width).astype(np.int64)
            own = _column(batch, "cluster").to_numpy()
            upper = (_column(batch, "upper").to_numpy() + moved[own]) * (1 + SLACK)
            lower = np.maximum(_matrix(_column(batch, "lower"), k) - moved, 0) * (1 - SLACK)
            own, upper, lower, count = assign(x, own, upper, lower, centroids)
            computed = np.zeros(len(own), np.int64)
            computed[:1] = count
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), _column(batch, "v"), pa.array(own, pa.int32()), pa.array(upper), _rows(lower, pa.float64()), pa.array(computed)], ["id", "v", "cluster", "upper", "lower", "computed"])

    return run


def _last(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _column(batch, "cluster").to_numpy()
            x = _matrix(_column(batch, "v"), centroids.shape[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), _column(batch, "cluster"), pa.array(squared(x, centroids[own]))], ["id", "cluster", "distance"])

    return run


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component, as 32-bit integers; an error names a component that is too large."""
    value = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.when(fits(x), value(x)).otherwise(F.raise_error(F.lit(f"a scaled component is not within {LARGEST}"))).cast("int"))


def whole(vector: Column, width: int) -> Column:
    """Whether a vector has exactly `width` components, none null, infinite or not a number."""
    wrong = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) == width) & ~F.exists(vector, wrong), F.lit(False))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray, int]:
    """(id, cluster, distance) for each kept vector, the centroids in their order, and the number of distances computed in
    the assignments. distance is squared and exact.

    Kept are vectors of exactly `width` components, none null or non-finite. Centroids start as the k kept vectors with the
    smallest sha256 of the seed, a colon and the id (a null id counts as empty; of rows that repeat an id, the smaller
    vector comes first). Each round assigns all vectors, then replaces each non-empty centroid by its vectors' exact mean,
    rounded down by component; empty ones stay. Then vectors are assigned once more. With fewer than k vectors, each starts
    a centroid; an empty table gives no rows and no centroids. Columns other than the two named are not read.

    A round reads the vectors with their bounds once and writes them once; nothing but sums is shuffled. Every component,
    scaled, must be within LARGEST, or the job ends with an error: squared distances are 64-bit integers.
    """
    if width * (2 * LARGEST) ** 2 >= 2**63:
        raise ValueError("too many components for 64-bit distances")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`")
    kept = vectors.where(whole(vector, width)).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), integers(vector, scale).alias("v"))
    kept = scratch.keep(kept, "vectors")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(digits.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), np.zeros((0, width), np.int64), 0
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    none = F.array_repeat(F.lit(0.0), k)
    state = kept.select("id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), none.alias("lower"), F.lit(0).cast("bigint").alias("computed"))
    moved, schema, computed = np.zeros(k), "id bigint, v array<int>, cluster int, upper double, lower array<double>, computed bigint", 0
    for i in range(rounds + 1):
        state = scratch.keep(state.mapInArrow(_step(centroids, moved), schema), "state")
        if i < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("computed").alias("c"), F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("s")).collect()
            old, centroids = centroids, centroids.copy()
            for r in sums:
                centroids[r.cluster] = np.array(r.s, np.int64) // r.n
            moved, computed = up(squared(old, centroids)), computed + sum(r.c for r in sums)
        else:
            computed += state.agg(F.sum("computed")).first()[0]
    scratch.drop("vectors")
    return state.mapInArrow(_last(centroids), "id bigint, cluster int, distance bigint"), centroids, computed
