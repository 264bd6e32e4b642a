"""Exact k-means by Shallot search: bounds, the remembered second-nearest centroid and a shrinking ball of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.vectors import SLACK, all_distances, discard, distances, integers, lists, matrix, settled_at, sums

STATE = "vec_id long, x array<int>, cluster int, second int, upper double, lower double"
RESULT = "vec_id long, cluster int, distance long"


@dataclass(frozen=True)
class Settings:
    """``clusters`` centroids over ``dims`` components of ``scale`` * x, moved ``rounds`` times; ``seed`` picks the first ones."""

    clusters: int = 40
    dims: int = 64
    scale: int = 256
    rounds: int = 5
    seed: str = "2"


class Centroids:
    """Centroids with what the search needs of them: mutual distances, each one's neighbours in order, how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        self.gaps = np.sqrt(all_distances(at, at).astype(np.float64))
        others = self.gaps + np.where(np.eye(k, dtype=bool), np.inf, 0.0)
        self.order = np.argsort(others, axis=1, kind="stable")[:, : k - 1]
        self.half = others.min(1, initial=np.inf) / 2
        moved = np.zeros(k) if before is None else np.sqrt(distances(at, before).astype(np.float64))
        self.moved = moved
        self.most = int(np.argmax(moved)) if k else 0
        rest = np.delete(moved, self.most)
        self.most_moved, self.next_moved = moved.max(initial=0.0), rest.max(initial=0.0)

    def __len__(self) -> int:
        return len(self.at)


def first_search(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, second, upper, lower) of vectors without a history: all centroids are compared. Ties go to the smaller number."""
    d = all_distances(x, c.at)
    rows = np.arange(len(x))
    cluster = d.argmin(1)
    upper = np.sqrt(d[rows, cluster].astype(np.float64))
    if len(c) == 1:
        return cluster, cluster.copy(), upper, np.full(len(x), np.inf)
    d[rows, cluster] = np.iinfo(np.int64).max
    second = d.argmin(1)
    return cluster, second, upper, np.sqrt(d[rows, second].astype(np.float64))


def search(x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for vectors with a history, after the centroids moved; also the number of distances it took.

    A vector keeps its centroid where the upper bound lies below the lower bound or half the way to the centroid's nearest
    neighbour. Otherwise its exact distances to that centroid and to the remembered second one are taken, the closer one
    is the middle of a ball, and its neighbours are scanned in order while they lie within (distance of the middle +
    distance of the second best so far): beyond, none can be among the two best. The ball shrinks with the second best.
    Bounds are doubles and only exclude by a margin; survivors are compared by integer distance, then number.
    """
    upper = upper + c.moved[cluster]
    lower = lower - np.where(cluster == c.most, c.next_moved, c.most_moved)
    cluster, second, taken = cluster.copy(), second.copy(), 0
    bound = np.maximum(lower, c.half[cluster]) * (1 - SLACK)
    rows = np.flatnonzero(~(upper * (1 + SLACK) < bound))
    d1 = distances(x[rows], c.at[cluster[rows]])
    upper[rows] = np.sqrt(d1.astype(np.float64))
    taken += len(rows)
    still = ~(upper[rows] * (1 + SLACK) < bound[rows])
    rows, d1 = rows[still], d1[still]
    if not len(rows):
        return cluster, second, upper, lower, taken
    one, two = cluster[rows], second[rows]
    d2 = distances(x[rows], c.at[two])
    taken += len(rows)
    swap = (d2 < d1) | ((d2 == d1) & (two < one))
    one, two, d1, d2 = np.where(swap, two, one), np.where(swap, one, two), np.where(swap, d2, d1), np.where(swap, d1, d2)
    middle, reach, live = one.copy(), np.sqrt(d1.astype(np.float64)), np.arange(len(rows))
    for step in range(c.order.shape[1]):
        j = c.order[middle[live], step]
        near = c.gaps[middle[live], j] <= (reach[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + SLACK)
        live, j = live[near], j[near]
        if not len(live):
            break
        fresh = j != two[live]
        at, j = live[fresh], j[fresh]
        d = distances(x[rows[at]], c.at[j])
        taken += len(at)
        best = (d < d1[at]) | ((d == d1[at]) & (j < one[at]))
        better = ~best & ((d < d2[at]) | ((d == d2[at]) & (j < two[at])))
        up, mid = at[best], at[better]
        two[up], d2[up] = one[up], d1[up]
        one[up], d1[up] = j[best], d[best]
        two[mid], d2[mid] = j[better], d[better]
    cluster[rows], second[rows] = one, two
    upper[rows], lower[rows] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
    return cluster, second, upper, lower, taken


def _starts(kept: DataFrame, settings: Settings) -> np.ndarray:
    """The first centroids: the vectors whose ``seed:vec_id`` hashes least, in order of the hash, then of the components."""
    drawn = kept.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return np.array([r.x for r in drawn.orderBy("h", "x").limit(settings.clusters).collect()], np.int64).reshape(-1, settings.dims)


def _state(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, ...]:
    numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
    return matrix(batch.column(1), dims), numbers[0].astype(np.int64), numbers[1].astype(np.int64), numbers[2], numbers[3]


def _batch(ids: pa.Array, x: np.ndarray, found: tuple) -> pa.RecordBatch:
    cluster, second, upper, lower = found[:4]
    columns = [ids, lists(x, pa.int32()), pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "cluster", "second", "upper", "lower"])


def clustered(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, final centroids as integers).

    Each round reads the vectors with their bounds once, writes them with new bounds to the shared folder and then deletes the
    table of the round before; sums are made where the rows are. Only centroids, ``clusters`` x ``dims`` numbers, pass the driver.
    Empty centroids stay where they are. Fewer vectors than centroids make fewer centroids; vectors without an id, which start none,
    make none on their own, and then no row comes back.
    """
    if settings.clusters < 1 or settings.rounds < 1:
        raise ValueError("at least one centroid and one round are needed")
    spark, dims = vectors.sparkSession, settings.dims
    kept = integers(vectors, settings.scale, dims)
    at = _starts(kept, settings)
    if not len(at):
        return spark.createDataFrame([], RESULT), at
    now = Centroids(at)

    def begin(batches: Iterator[pa.RecordBatch], c: Centroids = now) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            yield _batch(batch.column(0), x, first_search(x, c))

    state, path = settled_at(kept.mapInArrow(begin, STATE))
    for number in range(settings.rounds):
        found = sums(state, ["x", "cluster"], lambda b: (b.column(1).to_numpy(), matrix(b.column(0), dims)), dims)
        at = at.copy()
        for k, (n, total) in found.items():
            at[k] = [s // n for s in total]
        now = Centroids(at, now.at)

        def go_on(batches: Iterator[pa.RecordBatch], c: Centroids = now, last: bool = number == settings.rounds - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, *bounds = _state(batch, dims)
                out = search(x, *bounds, c)
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int32()), pa.array(distances(x, c.at[out[0]]))], ["vec_id", "cluster", "distance"])
                else:
                    yield _batch(batch.column(0), x, out)

        last = number == settings.rounds - 1
        old = path
        state, path = settled_at(state.mapInArrow(go_on, RESULT if last else STATE))
        discard(spark, old)
    return state, at


def digest(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Inertias are exact sums; one beyond 64 bits is null. Which vectors take part, and what becomes of null and repeated ids, is said at
    ``integers`` and ``clustered``; extra columns do not matter.
    """
    rows, at = clustered(vectors, settings)
    own = {r.cluster: int(r.own) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    named = [(i, fits(own.get(i, 0)), fits(sum(own.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(at.tolist())]
    # One row for each centroid, so at most ``clusters`` rows are broadcast.
    per = rows.sparkSession.createDataFrame(named, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), F.col("cluster") == F.col("number")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
