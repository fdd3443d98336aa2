"""Canopy generation and assignment, as a function of the data alone.

Points are visited in an order by a hash of what they are, not of where they lie:
by md5 of their components in units of 2**-20 (rounded down), ties by the points
themselves.  A point that has no earlier founder within t2 founds a canopy, and
joins every earlier canopy within t1.  So the canopies don't depend on partitions, nor on
the order of rows, and repeated points count as often as they occur.

Founders are found by rounds. A round takes the next points in order, a bounded
number of those still open, decides them one after another, and sends the new
founders to all tasks; these drop what lies within t2, and add up the members
within t1.  As the order is random to the points' places, most points of a dense
region go in the first rounds; all rounds together are about as many as there are
batches of founders.  No list of all canopies is held anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources.storage import Scratch, Stored
from ..rows import numbered
from .blocks import Block, Dense, block, steps, within
from .common import SPARSE, Cluster, dense_vector, distinct, fold, fold_frame, moments, nearest_center, order_key, read_clusters, vector

#: Points that a round decides at most, and bytes of their components.
BATCH = 8192
BATCH_BYTES = 32 << 20

MODEL = "cluster int, founder array<double>, center array<double>, members long"


def canopies(x: np.ndarray, t1: float, t2: float) -> tuple[np.ndarray, np.ndarray]:
    """Centers (means of members) and member counts of points in the given order; the rule by itself."""
    founders = founding(x, t2)
    inside = within(Dense(x), x[founders], t1) & (np.arange(len(x))[:, None] >= founders[None, :]) if len(founders) else np.zeros((len(x), 0), bool)
    counts = inside.sum(0)
    return Dense(x).mixed(inside.astype(float)) / np.maximum(1, counts)[:, None], counts


def founding(x: np.ndarray, t2: float) -> np.ndarray:
    """Which points, in the given order, have no earlier founder within t2."""
    found: list[int] = []
    for s in range(0, len(x), 256):
        part = x[s : s + 256]
        free = ~within(Dense(part), x[found], t2).any(1) if found else np.ones(len(part), bool)
        near = within(Dense(part), part, t2)
        for i in range(len(part)):
            if free[i]:
                found.append(s + i)
                free &= ~near[i]
    return np.array(found, int)


def _in_order(points: DataFrame) -> tuple[Stored, DataFrame]:
    """Distinct finite points with their number ``n`` and ``place``."""
    finite = lambda x: F.abs(x) < float("inf")  # noqa: E731  NaN is above all
    if vector(points) == SPARSE:
        rows = distinct(points.where(F.forall(F.map_values("entries"), finite)))
        listed = F.array_sort(F.map_entries("entries"))
        return numbered(rows.select("size", "entries", "n", listed.alias("listed"), order_key(dense_vector()).alias("key")), "key", "listed")
    rows = distinct(points.where(F.forall("point", finite)))
    return numbered(rows.withColumn("key", order_key(F.col("point"))), "key", "point")


def model(points: DataFrame, t1: float, t2: float, batch: int = BATCH) -> Scratch | None:
    """A stored table of MODEL, of any number of canopies, in the order of their founders; None if there are no points.

    Points with components that are null or not finite take no part.
    """
    if not t1 > t2 > 0:
        raise ValueError("t1 > t2 > 0 is needed")
    spark, at = points.sparkSession, vector(points)
    held, ordered = _in_order(points)
    total = held.df.count()
    if not total:
        held.drop()
        return None
    first = matrix_of(held.df.select(*at).limit(1).toArrow(), at)
    batch = max(1, min(batch, BATCH_BYTES // (8 * max(1, first.shape[1]))))
    out, found, lo, open_ = Scratch(spark), 0, 0, None
    while lo < total:
        now = open_.df if open_ else ordered.select(*at, "place")
        left = total if open_ is None else now.count()
        if not left:
            break
        hi = min(total, lo + max(1, batch * (total - lo) // left))
        while True:
            got = now.where((F.col("place") >= lo) & (F.col("place") < hi)).limit(2 * batch + 1).toArrow()
            if got.num_rows <= 2 * batch or hi - lo == 1:
                break
            hi = lo + max(1, (hi - lo) // 2)
        got = got.sort_by("place")
        x, place = matrix_of(got, at), got["place"].to_numpy()
        chosen = founding(x, t2)
        founders, places = x[chosen], place[chosen]
        if len(chosen):
            sums = fold(ordered.where(F.col("place") >= int(places[0])), _members(founders, places, t1), ("place", "n"), blocks=True)
            rows = [(found + k, founders[k].tolist(), (s[1:] / s[0]).tolist(), int(s[0])) for k, s in sums.items()]
            spark.createDataFrame(rows, MODEL).write.mode("append").parquet(out.path)
            found += len(chosen)
        if hi < total:
            after = Stored(_uncovered(now.where(F.col("place") >= hi), founders, t2))
            if open_:
                open_.drop()
            open_ = after
        lo = hi
    for done in (held, open_):
        if done:
            done.drop()
    return out


def matrix_of(rows: pa.Table, at: list[str]) -> np.ndarray:
    made = [block([b.column(c) for c in at]).dense() for b in rows.combine_chunks().to_batches() if b.num_rows]
    return np.vstack(made) if made else np.zeros((0, 0))


def _members(founders: np.ndarray, places: np.ndarray, t1: float):  # noqa: ANN202
    def part(b: Block, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(founders), b.d + 1))
        for s, some in steps(b, len(founders)):
            here = slice(s, s + some.n)
            w = (within(some, founders, t1) & (place[here, None] >= places[None, :])) * n[here, None].astype(float)
            total[:, 0] += w.sum(0)
            total[:, 1:] += some.mixed(w)
        met = np.flatnonzero(total[:, 0])
        return met, total[met]

    return part


def _free(b: Block, founders: np.ndarray, t2: float) -> np.ndarray:
    """Which points have no founder within t2."""
    return np.concatenate([~within(some, founders, t2).any(1) for _, some in steps(b, len(founders))])


def _uncovered(open_: DataFrame, founders: np.ndarray, t2: float) -> DataFrame:
    """Points without a founder within t2."""
    at = [open_.columns.index(c) for c in vector(open_)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(founders):
                batch = batch.filter(pa.array(_free(block([batch.column(i) for i in at]), founders, t2)))
            yield batch

    return open_.mapInArrow(run, open_.schema)


def by_nearest(points: DataFrame, centers: DataFrame, block_size: int = BATCH) -> DataFrame:
    """points with the nearest of any number of centers (cluster int from 0, center), the first of equals; a pass for each block of centers."""
    many = centers.count()
    at, plain = [points.columns.index(c) for c in vector(points)], points.columns
    now, held = points, None
    for lo in range(0, max(1, many), block_size):
        got = centers.where((F.col("cluster") >= lo) & (F.col("cluster") < lo + block_size)).select("cluster", "center").toArrow().sort_by("cluster")
        c = matrix_of(got, ["center"])
        now = _nearer(now, c, lo, at, lo > 0)
        if lo + block_size < many:
            after = Stored(now)
            if held:
                held.drop()
            held, now = after, after.df
    return now.select(*plain, "cluster")


def _nearer(points: DataFrame, c: np.ndarray, lo: int, at: list[int], going: bool) -> DataFrame:
    schema = points.schema if going else T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("away", T.DoubleType())])
    width = len(schema.fields) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, away = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.inf)
            if batch.num_rows and len(c):
                own, away, _ = nearest_center(block([batch.column(i) for i in at]), c)
                own += lo
                if going:
                    last, before = (batch.column(width + k).to_numpy(zero_copy_only=False) for k in range(2))
                    own, away = np.where(away < before, own, last), np.minimum(away, before)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(own).cast(pa.int32()), pa.array(away)], names=schema.names)

    return points.mapInArrow(run, schema)


def canopy_frames(points: DataFrame, t1: float, t2: float, should_cluster: bool = True, batch: int = BATCH) -> tuple[DataFrame, DataFrame | None]:
    """(cluster, center, radius, n) of any number of canopies: radius and number are those of the points nearest to a center; and points with ``cluster``."""
    spark = points.sparkSession
    made = model(points, t1, t2, batch)
    if made is None:
        none = spark.createDataFrame([], "cluster int, center array<double>, radius array<double>, n long")
        return none, points.withColumn("cluster", F.lit(0)) if should_cluster else None
    found = spark.read.schema(MODEL).parquet(made.path)
    clustered = by_nearest(points, found, batch)
    sums = fold_frame(clustered, lambda b, k: moments(b, k), ("cluster",))
    d = F.size("center")
    n, mean, square = F.get("row", F.lit(0)), F.slice("row", 2, d), F.slice("row", d + 2, d)
    spread = F.zip_with(F.transform(square, lambda x: x / n), F.transform(mean, lambda x: x / n), lambda q, m: F.sqrt(F.greatest(F.lit(0.0), q - m * m)))
    model_ = found.join(sums, found["cluster"] == sums["k"], "left").select(
        "cluster", "center", F.coalesce(F.when(n > 0, spread), F.transform("center", lambda _: F.lit(0.0))).alias("radius"), F.coalesce(n, F.lit(0.0)).cast("long").alias("n"))
    return model_, clustered if should_cluster else None


def canopy(points: DataFrame, t1: float, t2: float, should_cluster: bool = True, batch: int = BATCH) -> tuple[list[Cluster], DataFrame | None]:
    """Canopies as a model on the driver (at most MAX_CLUSTERS, else an error; ``canopy_frames`` has no such bound); with ``should_cluster`` also the points by nearest center."""
    made, clustered = canopy_frames(points, t1, t2, should_cluster, batch)
    return read_clusters(made), clustered


def clusters_of(centers: np.ndarray, sums: dict[int, np.ndarray]) -> list[Cluster]:
    """Clusters with the radius (deviation per dimension) and number of their points; ``sums``: n, sum, sum of squares."""
    out, d = [], centers.shape[1]
    for k, c in enumerate(centers):
        s = sums.get(k)
        if s is None:
            out.append(Cluster(k, c, np.zeros(d), 0))
        else:
            mean = s[1 : d + 1] / s[0]
            out.append(Cluster(k, c, np.sqrt(np.maximum(0, s[d + 1 :] / s[0] - mean**2)), int(s[0])))
    return out
