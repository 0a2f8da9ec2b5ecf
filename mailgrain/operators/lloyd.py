"""K-means of several spaces with all restarts in one reading per iteration.

A space is a set of points with a number of clusters of its own.  Each iteration is one Arrow pass over the points of all
spaces: a task adds up, for every space, restart and cluster, the members' weights, vectors and squared distances,
and nothing else leaves it.  Points that are equal may be one row with a weight.  Centres are the only thing the driver
holds: spaces x restarts x clusters x dimensions numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS, TOLERANCE = 50, 1e-4
#: rows the first centres are chosen from; a bounded sample, all rows take part in every iteration
SEED_ROWS = 4096
POINTS = "space int, point array<double>, weight double"
SUMS = "space int, restart int, cluster int, weight double, cost double, total array<double>"


@dataclass
class Fit:
    """Centres of the best restart of a space, and the cost of every restart (weighted squared distances)."""

    centres: np.ndarray
    costs: list[float] = field(default_factory=list)
    iterations: int = 0

    @property
    def cost(self) -> float:
        return min(self.costs)


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each point to each centre; differences of coordinates, so that equal points have distance 0."""
    if points.shape[1] <= 16:
        return ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    lengths = (points ** 2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(axis=1)
    return np.maximum(lengths, 0)


def spread_centres(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres by k-means++: each further one is drawn with the squared distance to those before."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = squared_distances(points, points[chosen])[:, 0]
    while len(chosen) < k:
        mass = near * weights
        if mass.sum() <= 0:  # fewer different points than clusters
            break
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        near = np.minimum(near, squared_distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: dict[tuple[int, int], np.ndarray] = shared.value
        totals = {key: (np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)) for key, c in centres.items()}
        for batch in batches:
            space = np.asarray(batch.column("space"))
            for number in np.unique(space).tolist():
                own = batch.filter(pa.array(space == number))
                points, weights = matrix_of(own.column("point")), np.asarray(own.column("weight"))
                for (at, restart), c in centres.items():
                    if at != number:
                        continue
                    apart = squared_distances(points, c)
                    nearest = apart.argmin(axis=1)
                    weight, cost, total = totals[at, restart]
                    weight += np.bincount(nearest, weights, len(c))
                    cost += np.bincount(nearest, weights * apart[np.arange(len(points)), nearest], len(c))
                    member = np.zeros((len(c), len(points)))
                    member[nearest, np.arange(len(points))] = weights
                    total += member @ points
        rows = [(s, r, k, float(w[k]), float(c[k]), t[k].tolist()) for (s, r), (w, c, t) in totals.items() for k in np.flatnonzero(w).tolist()]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
                 pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.list_(pa.float64()))],
                ["space", "restart", "cluster", "weight", "cost", "total"])

    return run


def first_centres(points: DataFrame, clusters: dict[int, int], seed: int, restarts: int) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (space, restart), from at most ``SEED_ROWS`` rows of each space, those of the smallest hash."""
    out = {}
    for space, k in clusters.items():
        rows = points.filter(F.col("space") == space).orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(max(SEED_ROWS, k)).select(
            "point", "weight").toArrow()
        if not rows.num_rows:
            raise ValueError("nothing to cluster")
        sample, weights = matrix_of(rows.column("point").combine_chunks()), rows.column("weight").to_numpy()
        for restart in range(restarts):
            out[space, restart] = spread_centres(sample, weights, k, np.random.default_rng((seed, space, restart)))
    return out


def fit_spaces(
    points: DataFrame, clusters: dict[int, int], seed: int = 42, restarts: int = 10, iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE, start: dict[tuple[int, int], np.ndarray] | None = None,
) -> dict[int, Fit]:
    """Lloyd's iterations over ``points`` (:data:`POINTS`, stored) for every space and restart at once.

    A restart ends when no centre moves more than ``tolerance``; restarts that go on are the only ones in the next pass.
    A cluster that loses all members keeps its centre.  The last pass takes the costs of all final centres.
    """
    context = points.sparkSession.sparkContext
    centres = start or first_centres(points, clusters, seed, restarts)
    moving = set(centres)
    rounds = dict.fromkeys(centres, 0)
    costs: dict[tuple[int, int], float] = {}
    for step in range(iterations + 1):
        last = step == iterations or not moving
        now = dict(centres) if last else {key: centres[key] for key in moving}
        shared = context.broadcast(now)
        # partial sums are combined by Spark: one row for each task and cluster goes in, one for each cluster comes out
        sums = points.mapInArrow(_sums(shared), SUMS).groupBy("space", "restart", "cluster").agg(
            F.sum("weight").alias("weight"), F.sum("cost").alias("cost"),
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).collect()
        shared.unpersist()
        costs |= dict.fromkeys(now, 0.0)
        moved = {key: c.copy() for key, c in now.items()}
        for row in sums:
            key = (row["space"], row["restart"])
            costs[key] += row["cost"]
            moved[key][row["cluster"]] = np.asarray(row["total"]) / row["weight"]
        if last:
            break
        for key in now:
            rounds[key] += 1
            if np.sqrt(((moved[key] - centres[key]) ** 2).sum(axis=1)).max() <= tolerance:
                moving.discard(key)
            centres[key] = moved[key]
    out = {}
    for space in clusters:
        own = sorted(key for key in centres if key[0] == space)
        best = min(own, key=lambda key: (costs[key], key))
        out[space] = Fit(centres[best], [costs[key] for key in own], max(rounds[key] for key in own))
    return out


def assign(rows: DataFrame, key: str, spaces: dict[str, tuple[str, Fit]]) -> DataFrame:
    """``key`` and, for every name, ``<name>_cluster`` and ``<name>_distance`` of the point in the given column.

    Centres are at most 100 a space and go along with the tasks.  A null point has neither.
    """
    shared = rows.sparkSession.sparkContext.broadcast({name: fit.centres for name, (_, fit) in spaces.items()})
    columns = {name: column for name, (column, _) in spaces.items()}
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = [batch.column(key)], [key]
            for name, column in columns.items():
                values = batch.column(column)
                present = np.flatnonzero(np.asarray(values.is_valid()))
                cluster, distance = np.zeros(len(values), np.int32), np.zeros(len(values))
                if len(present):
                    apart = squared_distances(matrix_of(values.take(pa.array(present))), shared.value[name])
                    cluster[present] = apart.argmin(axis=1)
                    distance[present] = np.sqrt(apart[np.arange(len(present)), cluster[present]])
                absent = np.ones(len(values), bool)
                absent[present] = False
                out += [pa.array(cluster, mask=absent), pa.array(distance, mask=absent)]
                names += [f"{name}_cluster", f"{name}_distance"]
            yield pa.RecordBatch.from_arrays(out, names)

    more = ", ".join(f"{name}_cluster int, {name}_distance double" for name in spaces)
    return rows.mapInArrow(run, f"{key} {kind}, {more}")
