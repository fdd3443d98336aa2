"""Points, clusters and partial sums over points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ...sources.schema import vector_columns
from ..rows import vectorize
from .blocks import Block, Dense, block
from .blocks import nearest as nearest_center

#: Clusters of a model at most: models go to all tasks.
MAX_CLUSTERS = 100_000


@dataclass(frozen=True)
class Cluster:
    id: int
    center: np.ndarray
    radius: np.ndarray
    n: int


#: The columns of a sparse vector.
SPARSE = ["size", "entries"]


def vector(df: DataFrame) -> list[str]:
    """The columns that hold the points: ``point``, or ``size`` and ``entries`` of sparse ones."""
    return ["point"] if "point" in df.columns else SPARSE


#: Names of kinds of vectors, and whether they are sparse.
KINDS = {"dense": False, "sparse": True, "sequential-sparse": True, "random-access-sparse": True}


def as_points(df: DataFrame, columns: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """A table's points: its ``point`` column, or its sparse vectors, if it has them, else a vector of the columns (all but text).

    Vectors that hold a null are left out. ``kind``: one of KINDS, into which the points are turned; None leaves them as they are.
    """
    if kind is not None and kind not in KINDS:
        raise ValueError(f"unknown kind of vector {kind!r}; one of {', '.join(KINDS)}")
    points = _as_points(df, columns)
    if kind is None or KINDS[kind] == (vector(points) == SPARSE):
        return points
    if KINDS[kind]:
        entries = F.filter(F.transform("point", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
        return points.withColumns({"size": F.size("point"), "entries": F.map_from_entries(entries)}).drop("point")
    return points.withColumn("point", dense_vector()).drop(*SPARSE)


def _as_points(df: DataFrame, columns: list[str] | None) -> DataFrame:
    if columns is None and "point" in df.columns:
        return df.where(F.col("point").isNotNull() & F.forall("point", lambda x: x.isNotNull())).withColumn("point", F.col("point").cast("array<double>"))
    if columns is None and set(SPARSE) <= set(df.columns):
        df = df.where(F.col("size").isNotNull() & F.col("entries").isNotNull() & F.forall(F.map_values("entries"), lambda x: x.isNotNull()))
        return df.withColumns({"size": F.col("size").cast("int"), "entries": F.col("entries").cast("map<int,double>")})
    return vectorize(df, columns or vector_columns(df.schema))


def dense_vector() -> Column:
    """The sparse vector's components in order, zeros included."""
    return F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at("entries", i), F.lit(0.0)))


def distinct(points: DataFrame) -> DataFrame:
    """The distinct vectors and ``n``, the number of points of each."""
    if vector(points) != SPARSE:
        return points.groupBy("point").agg(F.count("*").alias("n"))
    # Maps can't be grouped, their sorted entries can.
    listed = F.array_sort(F.filter(F.map_entries("entries"), lambda e: e["value"] != 0))
    return points.groupBy("size", listed.alias("listed")).agg(F.count("*").alias("n")).select("size", F.map_from_entries("listed").alias("entries"), "n")


def order_key(point: Column) -> Column:
    """The md5 of a point's components in units of 2**-20, rounded down, with commas between."""
    return F.md5(F.array_join(F.transform(point, lambda x: F.floor(x * 1048576.0).cast("string")), ","))


def uniforms(points: DataFrame, seed: int, iteration: int | str) -> Column:
    """A number in (0, 1) for each point, from 13 digits of the md5 of the seed, the iteration and its components."""
    point = F.col("point") if vector(points) != SPARSE else dense_vector()
    h = F.md5(F.concat(F.lit(f"{seed}:{iteration}:"), order_key(point)))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / 16.0**13


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return block([column]).dense()


#: Numbers of a task's sums that are held before they are passed on: 64 MB.
HELD = 8 << 20


def fold_frame(points: DataFrame, part: Callable[..., tuple[np.ndarray, np.ndarray]], extra: tuple[str, ...] = ()) -> DataFrame:
    """(k, row): sums by key.  ``part`` turns a block of points (and arrays of the ``extra`` columns) into keys and a row of numbers per key; rows of a key are added up.

    A task adds up what it holds and passes on rows of keys, so what is shuffled has
    the size of the model for each task.
    """
    names, at = [*vector(points), *extra], len(vector(points))

    def out(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows = list(total.values())
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0)))
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), lists], ["k", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                more = [c.to_numpy(zero_copy_only=False) for c in batch.columns[at:]]
                for k, row in zip(*part(block(batch.columns[:at]), *more), strict=True):
                    total[int(k)] = total[int(k)] + row if int(k) in total else np.array(row, np.float64)
                if total and len(total) * len(next(iter(total.values()))) > HELD:
                    yield out(total)
                    total = {}
        yield out(total)

    parts = points.select(*names).mapInArrow(run, "k long, row array<double>")
    sums = parts.select("k", F.posexplode("row").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("row"))  # a row's numbers


def fold(points: DataFrame, part: Callable[..., tuple[np.ndarray, np.ndarray]], extra: tuple[str, ...] = (), blocks: bool = False) -> dict[int, np.ndarray]:
    """The sums of ``fold_frame`` on the driver, where the model is; without ``blocks``, ``part`` gets a matrix."""
    made = fold_frame(points, part if blocks else lambda b, *more: part(b.dense(), *more), extra).toArrow()
    rows = {}
    for chunk in made.to_batches():
        ends, flat = chunk.column("row").offsets.to_numpy(), chunk.column("row").values.to_numpy()
        rows |= {k: flat[a:b] for k, a, b in zip(chunk.column("k").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
    return dict(sorted(rows.items()))


def moments(b: Block, keys: np.ndarray, squares: bool = True, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys that have points, and number, sum and sum of squares of theirs; ``n``: how often each point counts, once without it."""
    found, at = np.unique(keys, return_inverse=True)
    parts = [b, *([b.squared()] if squares else [])]
    if n is not None:
        parts = [x.weighted(n) for x in parts]
    number = np.bincount(at, n, minlength=len(found)).astype(np.float64)[:, None]
    return found, np.hstack([number, *(x.sums(at, len(found)) for x in parts)])


def group_sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(found), rows.shape[1]))
    np.add.at(out, at, rows)
    return found, out


def assign(points: DataFrame, pick: Callable[..., np.ndarray], kind: T.DataType | None = None, name: str = "cluster", blocks: bool = False) -> DataFrame:
    """points with a column made from batches of points (matrices, or with ``blocks`` dense or sparse blocks); rows with -1 or null stay."""
    schema = T.StructType([*points.schema.fields, T.StructField(name, kind or T.IntegerType())])
    at, names = [points.columns.index(c) for c in vector(points)], [*points.columns, name]
    to = to_arrow_type(schema.fields[-1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(0)
            if batch.num_rows:
                b = block([batch.column(i) for i in at])
                made = pick(b if blocks else b.dense())
            new = pa.array(made.tolist(), to) if made.ndim > 1 else pa.array(made).cast(to)  # a row of several numbers is a list
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names)

    return points.mapInArrow(run, schema)


def nearest(centers: np.ndarray) -> Callable[[np.ndarray | Block], np.ndarray]:
    """Number of the nearest center by Euclidean distance; the first of equals."""
    return lambda x: nearest_center(x if isinstance(x, Block) else Dense(x), centers)[0]


def kept(points: DataFrame) -> DataFrame:
    """points in memory or on disk for loops; lost parts are computed again."""
    return points.persist(StorageLevel.MEMORY_AND_DISK)


def model_rows(df: DataFrame) -> list:
    """The rows of a model's table; more than a model may have are an error."""
    rows = df.limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    return rows


def read_clusters(df: DataFrame) -> list[Cluster]:
    """A written model (cluster, center, radius, n) again."""
    return [Cluster(r[0], np.array(r[1]), np.array(r[2]), r[3]) for r in sorted(model_rows(df.select("cluster", "center", "radius", "n")))]


def cluster_frame(spark, clusters: list[Cluster]) -> DataFrame:  # noqa: ANN001
    """(cluster, center, radius, n)"""
    rows = [(c.id, c.center.tolist(), c.radius.tolist(), c.n) for c in clusters]
    return spark.createDataFrame(rows, "cluster int, center array<double>, radius array<double>, n long")


def folded(clustered: DataFrame) -> DataFrame:
    """(cluster, count) of clustered points."""
    return clustered.groupBy("cluster").agg(F.count("*").alias("count"))
