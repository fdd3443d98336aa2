"""k-means from given clusters, with bounds that points carry from pass to pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources.storage import Stored
from .blocks import Block, block
from .blocks import nearest as nearest_center
from .canopy import clusters_of
from .common import HELD, Cluster, assign, distinct, fold, moments, nearest, vector

#: Centers up to which the distances between centers bound as well (they are compared with one another on the driver).
PAIRED = 2048


@dataclass
class Work:
    """Distances of points to centers that a run took, and those that Lloyd's passes would have taken."""

    taken: int = 0
    all: int = 0


def _reach(centers: np.ndarray) -> np.ndarray:
    """Half the distance of each center to the nearest other one, a little less; 0 for very many centers."""
    k = len(centers)
    if k < 2 or k > PAIRED:
        return np.full(k, np.inf if k < 2 else 0.0)
    out = np.empty(k)
    for s in range(0, k, 64):
        d = np.stack([((centers - c) ** 2).sum(1) for c in centers[s : s + 64]])
        d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
        out[s : s + 64] = 0.5 * np.sqrt(d.min(1))
    return out * (1 - 1e-9)


def bounded(b: Block, centers: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray | None, reach: np.ndarray) -> int:
    """Bring each point's nearest center and bounds (of the distance to it, and to any other) up to date in place; the number of distances taken.

    ``moved``: how far each center went since the last pass; None for the first. A
    point whose upper bound is below what any other center can reach keeps its
    center without a look; one more distance, to its own center, settles most others.
    """
    taken = 0
    if moved is None:
        doubt = np.arange(b.n)
    else:
        upper += moved[own]
        far = int(moved.argmax())
        second = np.partition(moved, -2)[-2] if len(moved) > 1 else 0.0
        lower -= np.where(own == far, second, moved[far])
        safe = np.maximum(lower, reach[own])
        doubt = np.flatnonzero(upper >= safe * (1 - 1e-12))
        if len(doubt):
            upper[doubt] = np.sqrt(b.pairs(doubt, centers, own[doubt])) * (1 + 1e-12)
            taken += len(doubt)
            doubt = doubt[upper[doubt] >= safe[doubt] * (1 - 1e-12)]
    if len(doubt):
        which, near, other = nearest_center(b.take(doubt), centers)
        own[doubt], upper[doubt], lower[doubt] = which, np.sqrt(near) * (1 + 1e-12), np.sqrt(other) * (1 - 1e-12)
        taken += len(doubt) * len(centers)
    return taken


#: What a distinct point carries, and rows of sums beside the points: key, number and sum (key -1: distances taken).
STATE = [("n", T.LongType()), ("own", T.LongType()), ("upper", T.DoubleType()), ("lower", T.DoubleType()), ("k", T.LongType()), ("row", T.ArrayType(T.DoubleType()))]


def _passed(points: DataFrame, at: list[str], centers: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    schema = T.StructType([*(T.StructField(c, points.schema[c].dataType) for c in at), *(T.StructField(n, t) for n, t in STATE)])
    reach, width, kinds = _reach(centers), len(at), [points.schema[c].dataType for c in at]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(t) for t in [*kinds, *(t for _, t in STATE)]]

    def sums(total: np.ndarray, taken: int) -> pa.RecordBatch:
        keys = np.flatnonzero(total[:, 0])
        rows = [[float(taken)], *total[keys].tolist()]
        n = len(rows)
        columns = [pa.nulls(n, t) for t in arrow[:-2]]
        return pa.RecordBatch.from_arrays([*columns, pa.array([-1, *keys.tolist()], pa.int64()), pa.array(rows, arrow[-1])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, taken = np.zeros((len(centers), centers.shape[1] + 1)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            b, n = block(batch.columns[:width]), batch.column(width)
            if moved is None:
                own, upper, lower = np.zeros(b.n, np.int64), np.zeros(b.n), np.zeros(b.n)
            else:
                own, upper, lower = (batch.column(width + i).to_numpy(zero_copy_only=False).copy() for i in (1, 2, 3))
            taken += bounded(b, centers, own, upper, lower, moved, reach)
            keys, rows = moments(b, own, False, n.to_numpy(zero_copy_only=False))
            total[keys] += rows
            nothing = [pa.nulls(b.n, t) for t in arrow[-2:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(own), pa.array(upper), pa.array(lower), *nothing], names=schema.names)
        yield sums(total, taken)

    return points.mapInArrow(run, schema)


def kmeans(
    points: DataFrame, initial: list[Cluster] | np.ndarray, convergence_delta: float = 0.0, iterations: int = 10, should_cluster: bool = True, work: Work | None = None
) -> tuple[list[Cluster], DataFrame | None]:
    """Move centers to the means of their points until none moves farther than ``convergence_delta``.

    A point goes to the nearest center, the first of equals; a center without
    points stays where it is: Lloyd's iteration. Each pass reads the points with
    their center and bounds as the pass before has stored them, takes only the
    distances that the triangle inequality leaves open, and stores them again beside
    its sums per center. Equal points go through the passes as one that counts as
    often as they occur. Dense and sparse points alike. ``work`` counts distances.
    """
    centers = np.array([c.center for c in initial] if len(initial) and isinstance(initial[0], Cluster) else initial, float)
    if not len(centers):
        raise ValueError("k-means needs initial clusters")
    if centers.size > HELD:
        raise ValueError(f"centers of {centers.size} numbers are too large a model")
    at, held, moved = vector(points), None, None
    now = distinct(points.select(*at))
    for _ in range(iterations):
        after = Stored(_passed(now, at, centers, moved))
        if held:
            held.drop()
        held, now, new = after, after.df.where("k is null"), centers.copy()
        sums = after.df.where("k is not null").select("k", F.posexplode("row").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).toArrow()
        k, i, x = (sums[c].to_numpy() for c in ("k", "i", "x"))
        if work is not None:
            work.taken += int(x[k < 0].sum())
        total = np.zeros((len(centers), centers.shape[1] + 1))
        total[k[k >= 0], i[k >= 0]] = x[k >= 0]
        met = total[:, 0] > 0
        if work is not None:
            work.all += int(total[:, 0].sum()) * len(centers)
        new[met] = total[met, 1:] / total[met, :1]
        moved = np.sqrt(((new - centers) ** 2).sum(1)) * (1 + 1e-12)
        centers = new
        if moved.max() <= convergence_delta * (1 + 1e-12):
            break
    pick = nearest(centers)
    sums = fold(now, lambda b, n: moments(b, pick(b), n=n), ("n",), blocks=True)
    if held:
        held.drop()
    return clusters_of(centers, sums), assign(points, pick, blocks=True) if should_cluster else None
