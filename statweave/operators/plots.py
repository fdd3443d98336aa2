"""The data behind plots: each function gives the frame that a chart draws."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import numeric_columns
from ..sources.storage import stored
from .brush import scaled
from .rows import sample_bernoulli
from .stats import GATHER, quantiles


def _columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    return list(columns) if columns else numeric_columns(df.schema)


def box_plot(df: DataFrame, columns: list[str] | None = None, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """(column, min, q1, median, q3, max); quartiles exact by default, of any number of distinct values."""
    names, at, parts = _columns(df, columns), [0.25, 0.5, 0.75], []
    many = df.agg(*[F.approx_count_distinct(c) for c in names]).first() if exact else []
    for i, c in enumerate(names):
        x = F.col(c).cast("double")
        if exact and many[i] > GATHER:
            q = [F.lit(v) for v in quantiles(df, c, at)]
        else:
            found = F.percentile(x, at) if exact else F.percentile_approx(x, at, accuracy)
            q = [found[k] for k in range(3)]
        parts.append(F.struct(F.lit(c).alias("column"), F.min(x).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("max")))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def indexed(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Row numbers from 0 in a stated order, without bringing all rows together: counts by range first, then numbers in each."""
    # Stored once, so that counts and numbers speak of the same partitions; the result reads it (see storage.release).
    placed = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())  # a row per partition
    start, starts = 0, []
    for p, n in counts:
        starts.append((p, start))
        start += n
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    # Numbers from monotonically_increasing_id run from 0 in each partition below its high bits.
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_start") + F.expr("_id & 8589934591")).drop("_part", "_start", "_id")


def scatter_plot(df: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """(index, series, value): one series per column, against the row number in a stated order."""
    names = _columns(df, columns)
    rows = indexed(df, order).select("index", *[F.col(c).cast("double").alias(c) for c in names])
    return rows.unpivot("index", names, "series", "value")


scatter_plot_grouped = scatter_plot


def frequencies_histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(column, bin, low, high, count): equal bins from each column's least to its greatest value, the greatest in the last bin; empty bins are there, columns without values are not.

    Two scans for all columns together: their bounds, and one count of (column, bin)
    pairs that combines before the shuffle.
    """
    names = _columns(df, columns)
    x = [F.col(c).cast("double") for c in names]
    bounds = df.agg(*[f(c) for c in x for f in (F.min, F.max)]).first() if names else []
    low, high = bounds[::2], bounds[1::2]
    there = [i for i in range(len(names)) if low[i] is not None]
    kinds = "place int, column string, low double, size double"
    shown = df.sparkSession.createDataFrame([(i, names[i], low[i], (high[i] - low[i]) / bins) for i in there], kinds)
    grid = shown.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    pairs = []
    for i in there:
        size = (high[i] - low[i]) / bins
        place = F.least(F.floor((x[i] - low[i]) / size), F.lit(bins - 1)).cast("int") if size else F.lit(0)
        pairs.append(F.when(x[i].isNotNull(), F.struct(F.lit(i).alias("place"), place.alias("bin"))))
    out = grid.withColumn("count", F.lit(0).cast("long"))
    if pairs:
        counts = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("at")).groupBy("at.place", "at.bin").agg(F.count("*").alias("count"))
        out = grid.join(F.broadcast(counts), ["place", "bin"], "left")  # a row per column and bin
    edge = lambda k: (F.col("low") + (F.col("bin") + k) * F.col("size"))
    return out.select("column", "bin", edge(0).alias("low"), edge(1).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def scatter_3d(df: DataFrame, columns: list[str]) -> DataFrame:
    if len(columns) != 3:
        raise ValueError("a 3-d plot needs exactly three columns")
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def parallel_lines(df: DataFrame, columns: list[str] | None = None, mode: str = "min_max") -> DataFrame:
    names = _columns(df, columns)
    return scaled(df.select(*names), names, mode)


def cluster_plots(points: DataFrame, columns: list[str], n: int = 2) -> dict[tuple[str, ...], DataFrame]:
    """(cluster, x, y) for each pair of columns, or (cluster, x, y, z) for each triple, of clustered points (cluster, point); outliers are left out of triples."""
    axes = ("x", "y", "z")[:n]
    shown = points.where(~F.startswith(F.col("cluster").cast("string"), F.lit("OUTLIER"))) if n == 3 else points
    at = {c: i for i, c in enumerate(columns)}
    return {d: shown.select("cluster", *[F.get("point", F.lit(at[c])).alias(a) for a, c in zip(axes, d, strict=True)]) for d in combinations(sorted(columns), n)}


def cluster_ellipses(clusters: DataFrame, columns: list[str]) -> dict[tuple[str, str], DataFrame]:
    """(cluster, x, y, rx, ry) for each pair of columns: the centers of clusters (cluster, center, radius) and the half axes around them."""
    at = {c: i for i, c in enumerate(columns)}
    part = lambda c, d, name: F.get(c, F.lit(at[d])).alias(name)
    return {(a, b): clusters.select("cluster", part("center", a, "x"), part("center", b, "y"), part("radius", a, "rx"), part("radius", b, "ry")) for a, b in combinations(sorted(columns), 2)}


KINDS = {
    "box-plot": box_plot,
    "scatter-plot": scatter_plot,
    "scatter-plot-grouped": scatter_plot_grouped,
    "frequencies-histogram": frequencies_histogram,
    "scatter-3d": scatter_3d,
    "parallel-lines": parallel_lines,
}


def view_table(kind: str, df: DataFrame, sample: float | None = None, seed: int | None = None, key: list[str] | None = None, **options) -> DataFrame:
    """The data of a plot of a table, or of a sample of its rows (by ``key``, if columns tell rows apart)."""
    if kind not in KINDS:
        raise ValueError(f"unknown plot {kind!r}; one of {', '.join(KINDS)}")
    return KINDS[kind](sample_bernoulli(df, sample, seed, key) if sample is not None else df, **options)
