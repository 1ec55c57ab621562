"""Centroid clustering (Lloyd's rounds, in exact integers) over a vector-approximation file.

1. Vectors with exactly ``dims`` finite components go on, each component x as the
   integer ``floor(scale * x)``.  The starting centroids are the ``k`` vectors with the
   smallest sha256 of ``<seed>:<id>``.
2. The VA-file: every dimension is cut into ``2**bits`` cells, and a vector is kept as
   its cell numbers, one byte a dimension, beside its full components.  The inner
   cell borders are quantiles of ``SAMPLE`` vectors, those with the smallest hashes; the
   outer borders are the smallest and the largest value of all rows, so every cell
   holds what it says.  The file is written to the shared folder once and read by every round.
3. In a round, lookup tables give, for a centroid, a dimension and a cell, the smallest and
   the largest squared distance that a value of the cell can have.  Their sums over the
   dimensions are a distance interval for each centroid.  A vector with one centroid whose
   interval begins below the smallest upper end is assigned by its cells alone.  Full vectors
   are fetched only where intervals overlap, and compared with the centroids left.
4. Tasks add up the components of their vectors per cluster; the sums of all are
   ``k * (dims + 1)`` numbers.  A centroid becomes the floor of its mean, an empty one stays.
5. A last assignment gives each vector its cluster and its exact squared distance.

Fetching happens inside the scan that holds the cells: a second table for the full
vectors would have to be shuffled in every round to meet the rows that ask for it.

No step groups vectors by cluster, so a cluster with a third of all rows is as cheap as
any other.  What reaches the driver are 2 * dims borders, SAMPLE vectors and the sums.

Edge cases: rows with a null vector, another length, or a null, NaN or infinite component
are left out; components beyond ``LARGEST`` in size count as ``LARGEST``, so that
distances fit a long; a vector with a null id is clustered but never a starting centroid;
rows with one id are vectors of their own, also as starting centroids (ordered by their
components); fewer than ``k`` ids give fewer centroids; without any, and for an empty table, no
rows return; ties go to the smaller centroid number; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import prepare, stage_table

#: Vectors that the inner cell borders are taken from.
SAMPLE = 2048
#: Largest size of a component: distances of up to 2**12 dimensions stay below 2**63 then.
LARGEST = 1 << 24
BITS = 5


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(_llm_id, _llm_v): the rows with ``dims`` finite components, as integers."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * F.lit(float(scale))))).cast("int")

    found = table.select(F.col(f"`{id_col}`").alias("_llm_id"), vector.alias("_llm_v")).filter((F.size("_llm_v") == dims) & F.forall("_llm_v", finite))
    return found.withColumn("_llm_v", F.transform("_llm_v", whole))


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """A fixed-length binary or list column as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
    if not len(column):
        return np.zeros((0, dims), kind)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    size = dims * np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[first : first + len(column) * size].view(kind).reshape(-1, dims)


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    size, rows = matrix.shape[1] * matrix.itemsize, matrix.shape[0]
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


class Cells:
    """Cell borders of every dimension, and the distance tables of a set of centroids."""

    def __init__(self, inner: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        #: Cell b of a dimension holds the integers from first[b] to last[b]; cells may be empty.
        self.inner = inner  # cells - 1 borders a dimension: a value belongs to the cell of the borders at most as large
        self.first = np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None])], 1)
        self.last = np.concatenate([np.clip(inner - 1, low[:, None], high[:, None]), high[:, None]], 1)

    @classmethod
    def fit(cls, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> Cells:
        """Inner borders at the sample's quantiles, outer ones at the given extremes."""
        at = np.arange(1, 1 << bits) * len(sample) >> bits
        return cls(np.ascontiguousarray(np.sort(sample, axis=0)[at].T), low, high)

    def number(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers of some vectors."""
        out = np.empty(vectors.shape, np.uint8)
        for d, borders in enumerate(self.inner):
            out[:, d] = np.searchsorted(borders, vectors[:, d], "right")
        return out

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest squared distance by dimension, cell and centroid."""
        below = self.first[:, :, None] - centroids.T[:, None, :]
        above = centroids.T[:, None, :] - self.last[:, :, None]
        near = np.maximum(0, np.maximum(below, above))
        far = np.maximum(np.abs(below), np.abs(above))
        return near * near, far * far

    @staticmethod
    def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distance intervals of vectors to all centroids, from their cells alone."""
        near, far = tables
        low = np.zeros((len(cells), near.shape[2]), np.int64)
        high = np.zeros_like(low)
        for d in range(cells.shape[1]):
            low += near[d][cells[:, d]]
            high += far[d][cells[:, d]]
        return low, high


def assign(cells: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, and the rows whose full vector was fetched to tell."""
    low, high = Cells.intervals(cells, tables)
    left = low <= high.min(axis=1, keepdims=True)
    nearest = left.argmax(axis=1)
    rows = np.flatnonzero(left.sum(axis=1) > 1)
    full = vectors[rows].astype(np.int64)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        asks = np.flatnonzero(left[rows, c])
        gap = full[asks] - centroid
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = distance < best[asks]
        best[asks[closer]] = distance[closer]
        nearest[rows[asks[closer]]] = c
    return nearest, rows


def _build(vectors: DataFrame, dims: int, bits: int, k: int, seed: int) -> tuple[DataFrame, Cells | None, np.ndarray]:
    """The written VA-file (_llm_id, cells, vector), its cells and the starting centroids."""
    spark = vectors.sparkSession
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_llm_id").cast("string")), 256)
    picked = vectors.select(hashed.alias("h"), "_llm_v").orderBy(F.col("h").asc_nulls_last(), "_llm_v").limit(max(SAMPLE, k)).collect()
    sample = np.array([r["_llm_v"] for r in picked], np.int64).reshape(-1, dims)
    centroids = sample[: min(k, sum(r["h"] is not None for r in picked))]

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            full = _matrix(batch.column(0), dims, np.int32)
            if len(full):
                low = full.min(axis=0) if low is None else np.minimum(low, full.min(axis=0))
                high = full.max(axis=0) if high is None else np.maximum(high, full.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = vectors.select("_llm_v").mapInArrow(extremes, "d int, low int, high int").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = np.array([(r["low"], r["high"]) for r in found.orderBy("d").collect()], np.int64).reshape(-1, 2)
    cells = Cells.fit(sample, ends[:, 0], ends[:, 1], bits) if len(sample) else None
    shared = spark.sparkContext.broadcast(cells)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = _matrix(batch.column(1), dims, np.int32)
            if len(full):
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(shared.value.number(full)), _binary(full)], ["_llm_id", "cells", "vector"])

    kind = vectors.schema["_llm_id"].dataType.simpleString()
    return stage_table(vectors.mapInArrow(approximate, f"_llm_id {kind}, cells binary, vector binary"), "va-file"), cells, centroids


def _sums(file: DataFrame, cells: Cells, centroids: np.ndarray) -> np.ndarray:
    """Per cluster the componentwise sums of its vectors, and in the last column their number."""
    k, dims = centroids.shape
    shared = file.sparkSession.sparkContext.broadcast((centroids, cells.tables(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, tables = shared.value
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            full = _matrix(batch.column(1), dims, np.int32)
            nearest, _ = assign(_matrix(batch.column(0), dims, np.uint8), full, middle, tables)
            order = np.argsort(nearest, kind="stable")
            found, starts = np.unique(nearest[order], return_index=True)
            if len(found):
                total[found, :dims] += np.add.reduceat(full[order].astype(np.int64), starts, axis=0)
                total[:, dims] += np.bincount(nearest, minlength=k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "part"])

    parts = file.select("cells", "vector").mapInArrow(run, "at int, part long").groupBy("at").agg(F.sum("part").alias("total"))
    total = np.zeros(k * (dims + 1), np.int64)
    for row in parts.collect():
        total[row["at"]] = row["total"]
    return total.reshape(k, dims + 1)


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3,
    dims: int = 64, scale: int = 64, bits: int = BITS, seed: int = 1,
) -> DataFrame:
    """One row per vector: the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``
    and ``centroid``, the final centroid's integers."""
    prepare(table.sparkSession)
    vectors = integer_vectors(table, id_col, vector_col, dims, scale)
    file, cells, centroids = _build(vectors, dims, bits, k, seed)
    kind = vectors.schema["_llm_id"].dataType.simpleString()
    names = f"`{id_col}` {kind}, cluster int, distance long"
    if not len(centroids):
        empty = file.sparkSession.createDataFrame([], f"{names}, cluster_inertia long, inertia long, centroid array<int>")
        return empty
    for _ in range(rounds):
        total = _sums(file, cells, centroids)
        held = total[:, dims] > 0
        centroids = centroids.copy()
        centroids[held] = total[held, :dims] // total[held, dims:]
    shared = file.sparkSession.sparkContext.broadcast((centroids, cells.tables(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, tables = shared.value
        for batch in batches:
            full = _matrix(batch.column(2), dims, np.int32)
            nearest, _ = assign(_matrix(batch.column(1), dims, np.uint8), full, middle, tables)
            gap = full.astype(np.int64) - middle[nearest]
            distance = np.einsum("ij,ij->i", gap, gap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(distance)], [id_col, "cluster", "distance"])

    found = stage_table(file.mapInArrow(run, names), "clusters")
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    per_cluster = F.array(*(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))))
    middles = F.array(*(F.array(*(F.lit(int(x)) for x in centroid)) for centroid in centroids))
    return found.select(
        F.col(f"`{id_col}`"), "cluster", "distance",
        F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(middles, F.col("cluster")).alias("centroid"),
    )


def centroid_hash(centroid: Column) -> Column:
    """sha256 of a centroid's components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
