"""Exact centroid clustering of integer vectors, with centroids filtered by n-simplex projection.

Pivots are chosen among the vectors of the smallest hashes so that the simplex they span is wide. A vector's distances to them
are computed once and kept as its apex: the coordinates of the point that has these distances to the simplex, the last of
them an altitude. Of two points, the distance of their apexes is never above their own distance, and with one altitude turned
over never below it. In each round, a centroid whose lower bound lies above the least upper bound of a vector is out; the
centroid of the least lower bound is measured exactly, which rules out more; what is left is compared by exact integer
distances, ties to the smaller number. Bounds carry a margin for rounding, so they never rule out a nearest centroid.

The vectors with their apexes are stored once in the shared folder. A round is one pass over them without a shuffle of vectors: each task
gives sums of at most (clusters x dimensions) integers, which Spark adds up, and the driver keeps the centroids, whose
number is a parameter. No group of vectors ever meets in one task, so a cluster that holds a third of them costs nothing more.

Vectors that are null, of another length, or hold a null or a number that is not finite are left out; rows with equal ids
or equal vectors each count. A null id is hashed as ``''``. Fewer vectors than centroids give fewer centroids, an empty
table gives an empty result, other columns are left out. A component beyond 2^27 after scaling is an error, as its
squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm import common

DIMENSIONS, SCALE = 64, 256
CLUSTERS, ROUNDS = 40, 5
SALT = "2:"
#: Pivots of the simplex at most, the vectors they are chosen from, and the altitude that a further one must have, in parts
#: of the widest distance (squared). Vectors that vary in all of 64 directions need nearly as many pivots: on such, 16 rule
#: out next to none of 40 centroids, 56 rule out five of six. Vectors of fewer directions give fewer pivots.
PIVOTS, POOL, FLAT = 56, 128, 1e-3
#: Vectors compared at once.
BLOCK = 4096
LARGEST = 1 << 27


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all others, as 64-bit integers."""
    return (vectors * vectors).sum(1)[:, None] + (others * others).sum(1)[None, :] - 2 * (vectors @ others.T)


class Simplex:
    """Pivots and the coordinates of the simplex they span, the first of them at the origin."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        """Takes pivots from ``points``: the first, then always the one of the largest altitude over those taken."""
        self.pivots = points[:1]
        self.corners = np.zeros((0, 0))
        self._invert()
        widest = float(squared(points, points).max()) if len(points) else 0.0
        while len(self.pivots) < min(most, len(points)):
            apexes = self.apexes(points)
            best = int(apexes[:, -1].argmax())
            if apexes[best, -1] ** 2 <= FLAT * widest:
                break
            size = len(self.corners)
            grown = np.zeros((size + 1, size + 1))
            grown[:size, :size] = self.corners
            grown[size] = apexes[best]
            self.corners = grown
            self.pivots = np.concatenate([self.pivots, points[best : best + 1]])
            self._invert()

    def _invert(self) -> None:
        self.inverse = np.linalg.inv(self.corners) if len(self.corners) else np.zeros((0, 0))
        self.norms = (self.corners**2).sum(1)
        self.reach = float(self.norms.max(initial=0.0))
        self.stretch = float(np.linalg.norm(self.inverse, 2)) if len(self.corners) else 0.0

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """One row per vector: its coordinates in the plane of the simplex, then its altitude above it."""
        far = squared(vectors, self.pivots).astype(np.float64)
        plane = (far[:, :1] - far[:, 1:] + self.norms) / 2 @ self.inverse.T
        height = np.sqrt(np.maximum(far[:, 0] - (plane**2).sum(1), 0))
        return np.column_stack([plane, height])

    def bounds(self, apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all squared distances, with a margin for the rounding of both sides."""
        own, their = (apexes**2).sum(1)[:, None], (others**2).sum(1)[None, :]
        middle = own + their - 2 * (apexes[:, :-1] @ others[:, :-1].T)
        turn = 2 * apexes[:, -1:] * others[:, -1][None, :]
        size = own + their.max(initial=0.0) + self.reach
        error = 1e-14 * size * (len(self.pivots) + 2) * (1 + size * self.stretch**2)
        margin = 4 * np.sqrt(size * error) + 8 * error + 1e-9
        return middle - turn - margin, middle + turn + margin


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its exact squared distance, and how many distances were measured."""
    n = len(vectors)
    own, their = (vectors * vectors).sum(1), (centroids * centroids).sum(1)

    def measure(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return own[rows] + their[numbers] - 2 * np.einsum("ij,ij->i", vectors[rows], centroids[numbers])

    low, high = simplex.bounds(apexes, simplex.apexes(centroids))
    guess = low.argmin(1)
    known = measure(np.arange(n), guess)
    # a bound is a float: an exact distance as one is rounded, hence the unit
    open_ = low <= np.minimum(high.min(1), known * (1 + 1e-12) + 1)[:, None]
    open_[np.arange(n), guess] = True
    rows, numbers = np.nonzero(open_)
    exact = measure(rows, numbers)
    first = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(exact, first) if n else exact
    # of a row's candidates, in the order of their numbers, the first one at the least distance
    hits = np.flatnonzero(exact == least[rows])
    chosen = hits[np.searchsorted(rows[hits], np.arange(n))]
    return numbers[chosen], least, n + len(rows)


def quantise(df: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``: floor(scale * x) of every component, of the vectors that have all of them."""
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(
        (F.size("v") == dimensions) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def leading(vectors: DataFrame, count: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; of equal hashes the smaller vector comes first."""
    key = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(count).collect()
    return np.array([r.v for r in rows], np.int64) if rows else np.zeros((0, 1), np.int64)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = len(column)
    width = len(column[0].as_py()) if rows else 0
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, width // 8)


def project(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """vec_id, ``v`` and ``apex`` as packed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.asarray(batch.column(1).flatten(), np.int64).reshape(batch.num_rows, -1)
            if whole.min() < -LARGEST or whole.max() > LARGEST:
                raise ValueError("a component lies beyond 2^27 after scaling")
            apexes = np.concatenate([simplex.apexes(whole[k : k + BLOCK]) for k in range(0, len(whole), BLOCK)])
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (whole.astype("<i8"), apexes.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["vec_id", "v", "apex"])

    return common.map_arrow(vectors, run, "vec_id long, v binary, apex binary")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, simplex: Simplex) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch: their first row, vectors, clusters and distances."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        vectors = _matrix(part.column(1), "<i8")
        number, distance, _ = nearest(vectors, _matrix(part.column(2), "<f8"), centroids, simplex)
        yield at, vectors, number, distance


def sums(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Per cluster the exact sums of its vectors' components, then their number."""
    count, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, width + 1), np.int64)
        for batch in batches:
            for _, vectors, number, _ in _assigned(batch, centroids, simplex):
                order = np.argsort(number, kind="stable")
                found, first = np.unique(number[order], return_index=True)
                total[found, :width] += np.add.reduceat(vectors[order], first)
                total[found, width] += np.diff(np.append(first, len(order)))
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(total[cluster, place])], ["cluster", "place", "total"]
        )

    parts = common.map_arrow(stored.select("vec_id", "v", "apex"), run, "cluster long, place long, total long")
    out = np.zeros((count, width + 1), np.int64)
    for row in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        out[row.cluster, row.place] = row.total
    return out


def assign(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """vec_id, cluster and the exact squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors, number, distance in _assigned(batch, centroids, simplex):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(vectors)), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    return common.map_arrow(stored.select("vec_id", "v", "apex"), run, "vec_id long, cluster int, distance long")


def moved(centroids: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Floor of the mean of every cluster that has vectors; the others stay."""
    count = totals[:, -1:]
    return np.where(count > 0, totals[:, :-1] // np.maximum(count, 1), centroids)


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, Simplex]:
    """The stored vectors with their apexes, the centroids after all rounds, and the simplex."""
    first = leading(vectors, max(clusters, POOL))
    centroids, simplex = first[:clusters], Simplex(first, pivots)
    stored = common.store(project(vectors, simplex), "centroid-vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, sums(stored, centroids, simplex))
    return stored, centroids, simplex


def classify(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = df.sparkSession
    stored, centroids, simplex = fit(quantise(df), clusters, rounds)
    found = common.store(assign(stored, centroids, simplex), "centroid-clusters")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    whole = sum(inertia.values())
    facts = [
        (number, inertia.get(number, 0), whole, hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest())
        for number, centre in enumerate(centroids)
    ]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid, whose number is a parameter
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
