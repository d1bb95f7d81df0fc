"""Centroid clustering of whole-number vectors by a progressive search in the Walsh-Hadamard domain.

A component x becomes floor(scale * x) and stays a whole number from then on.  The Walsh-Hadamard transform
keeps squared distances but for the factor of the dimension, so distances can be summed up coefficient by
coefficient, those of few sign changes first.  After the first stage each vector finishes the centroid that
looks nearest; every centroid whose sum is strictly larger than that distance already is out, and so on after
each further stage.  Those left finish all coefficients, so the nearest centroid is exact, and among equals
the smallest number wins.

A round maps the vectors to the count and the componentwise sum of every cluster, one row per cluster and
batch; only the centroids themselves (``clusters`` rows, a parameter) pass through the driver.  No vector is
shuffled, however many are alike.

Rows: vectors that are NULL, of another length, or hold NULL or non-finite components are left out.  A NULL id
is clustered but starts no centroid.  Repeated rows count each.  With fewer ids than ``clusters`` there are so many
centroids; equal starting ids are taken in the order of their vectors.  An empty table, or one without any id,
gives no rows.  Columns other than those named are not read.  Components beyond 2^62 end in an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import ship, stored

#: Coefficients added up by the end of each stage, as shares of the dimension.
STAGES = (1 / 8, 1 / 4, 1 / 2, 1)
#: Vectors searched at a time.
CHUNK = 4096
#: Whole numbers below this keep 64 squared differences of coefficients within 64 bits.
SAFE = 1 << 24


def coarse_first(dimension: int) -> np.ndarray:
    """Coefficients ordered by the sign changes of their Walsh function."""
    places = np.arange(dimension)
    signs = np.bitwise_count(places[:, None] & places[None, :]) & 1
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients, coarse first; whole numbers stay exact."""
    out, width = vectors.copy(), 1
    while width < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, width)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([a + b, a - b], axis=2).reshape(len(out), -1)
        width *= 2
    return out[:, coarse_first(out.shape[1])]


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, and the squared distance to it, of transformed points."""
    ends = [max(1, int(s * points.shape[1])) for s in STAGES]
    gap = points[:, None, : ends[0]] - centroids[None, :, : ends[0]]
    so_far = (gap * gap).sum(axis=2)
    guess = points - centroids[so_far.argmin(axis=1)]
    limit = (guess * guess).sum(axis=1)
    row, number = np.nonzero(so_far <= limit[:, None])
    total = so_far[row, number]
    for start, end in zip(ends, ends[1:], strict=False):
        gap = points[row, start:end] - centroids[number, start:end]
        total = total + (gap * gap).sum(axis=1)
        left = total <= limit[row]
        row, number, total = row[left], number[left], total[left]
    # rows come in order and every row has one centroid left at least
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, first) if len(first) else total
    hit = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, len(row)))))
    _, at = np.unique(row[hit], return_index=True)
    return number[hit[at]], least // points.shape[1]


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as Python's whole numbers where 64 bits do not hold all that follows."""
    scaled = np.floor(scale * vectors.astype(np.float64))
    if not len(scaled) or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)


def _chunks(batches: Iterator[pa.RecordBatch], dimension: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            flat = np.asarray(part.column("vector").flatten())
            yield part, whole(flat.reshape(-1, dimension), scale)


def _fitting(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points and centroids in one type, transformed."""
    exact = np.array(centroids, dtype=object)
    small = points.dtype != object and max(abs(c) for row in centroids for c in row) < SAFE
    kind = np.int64 if small else object
    return transform(points.astype(kind)), transform(exact.astype(kind))


def _sums(centroids: list[list[int]], dimension: int, scale: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk and cluster: number, rows, componentwise sums."""
        for _, points in _chunks(batches, dimension, scale):
            number, _ = nearest(*_fitting(points, centroids))
            found = np.unique(number)
            totals = [points[number == c].sum(axis=0).tolist() for c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.int32()),
                    pa.array([int((number == c).sum()) for c in found], pa.int64()),
                    pa.array(totals, pa.list_(pa.int64())),
                ],
                names=["cluster", "rows", "sums"],
            )

    return sums


def _assign(centroids: list[list[int]], dimension: int, scale: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in _chunks(batches, dimension, scale):
            number, distance = nearest(*_fitting(points, centroids))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    return assign


def _moved(rows: DataFrame, centroids: list[list[int]], dimension: int, scale: int) -> list[list[int]]:
    """The floor of the mean of each cluster; an empty cluster keeps its centroid."""
    partial = rows.mapInArrow(_sums(centroids, dimension, scale), "cluster int, rows bigint, sums array<bigint>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimension)]
    after = list(centroids)
    for row in partial.groupBy("cluster").agg(F.sum("rows").alias("rows"), *exact).collect():
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["rows"] for i in range(dimension)]
    return after


def usable(vector: Column, dimension: int) -> Column:
    """A vector of that length without NULL or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def cluster(
    df: DataFrame,
    clusters: int = 16,
    rounds: int = 3,
    scale: int = 64,
    dimension: int = 64,
    key: str = "vec_id",
    vector: str = "embedding",
    seed: str = "1",
) -> DataFrame:
    """The cluster of every vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the vectors with the smallest SHA-256 of ``seed:id``.  ``dimension`` is a power of two.
    """
    spark = df.sparkSession
    if dimension < 1 or dimension & (dimension - 1):
        raise ValueError("dimension must be a power of two")
    ship(spark)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = stored(rows.filter(usable(F.col("vector"), dimension)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter(F.col("id").isNotNull()).orderBy(digest, "vector").limit(clusters).select("vector").collect()
    schema = "vec_id bigint, cluster int, distance bigint"
    found = f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], found)
    centroids = whole(np.array([r["vector"] for r in first]), scale).tolist()
    for _ in range(rounds):
        centroids = _moved(rows, centroids, dimension, scale)
    placed = stored(rows.mapInArrow(_assign(centroids, dimension, scale), schema))
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    whole_sum = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = [(c, inertia.get(c, 0), whole_sum, digests[c]) for c in range(len(centroids))]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # as many rows as there are clusters
    joined = placed.join(F.broadcast(named), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
