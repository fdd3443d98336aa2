"""Selections on numeric axes: scaling, ranges, soft and angular brushes, brush algebra, axis histograms.

A brush is a table (row_id, weight) with weights from 0 to 1; rows that it
doesn't hold have weight 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = ("min_max", "zero_max", "global")


def axis_scale(df: DataFrame, columns: list[str], mode: str = "min_max") -> DataFrame:
    """(column, offset, scale) such that (x - offset) / scale lies in [0, 1] on each axis.

    "min_max": from each axis's least to its greatest value; "zero_max": from 0;
    "global": all axes from the least of all values and 0 to the greatest of all.
    """
    if mode not in SCALES:
        raise ValueError(f"unknown scaling {mode!r}; one of {', '.join(SCALES)}")
    bounds = F.array(*[F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")) for c in columns])
    one = df.agg(bounds.alias("b"))
    if mode == "global":
        lo = F.least(F.array_min(F.transform("b", lambda x: x["lo"])), F.lit(0.0))
        rows = one.select(F.explode("b").alias("x"), lo.alias("lo"), F.array_max(F.transform("b", lambda x: x["hi"])).alias("hi")).select("x.column", "lo", "hi")
    else:
        rows = one.select(F.inline("b"))
        if mode == "zero_max":
            rows = rows.withColumn("lo", F.lit(0.0))
    return rows.select("column", F.col("lo").alias("offset"), (F.col("hi") - F.col("lo")).alias("scale"))


def scaled(df: DataFrame, columns: list[str], mode: str = "min_max") -> DataFrame:
    """df with the columns scaled; an axis without extent gives 0."""
    by = {r["column"]: (r["offset"], r["scale"]) for r in axis_scale(df, columns, mode).collect()}  # a row per column
    return df.withColumns({c: ((F.col(c).cast("double") - by[c][0]) / by[c][1]) if by[c][1] else F.lit(0.0) for c in columns})


def in_range(column: str, lo: float, hi: float) -> Column:
    """lo <= x < hi"""
    return (F.col(column) >= lo) & (F.col(column) < hi)


def range_count(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.where(in_range(column, lo, hi)).agg(F.count("*").alias("count"))


def brushed_count(df: DataFrame, brush: DataFrame, column: str, lo: float, hi: float, row_id: str = "row_id") -> DataFrame:
    """The sum of a brush's weights over the rows in a range, cut to a whole number."""
    return df.where(in_range(column, lo, hi)).select(row_id).join(brush, row_id).agg(F.coalesce(F.floor(F.sum("weight")), F.lit(0)).cast("long").alias("count"))


def soft_brush(df: DataFrame, column: str, lo: float, hi: float, radius: float | None = None, row_id: str = "row_id") -> DataFrame:
    """Weight 1 in [lo, hi], falling to 0 over ``radius`` (a fifth of the range) on both sides; rows of weight 0 are left out."""
    r = 0.2 * (hi - lo) if radius is None else radius
    v = F.col(column).cast("double")
    weight = F.when((v >= lo) & (v <= hi), F.lit(1.0))
    if r > 0:
        weight = weight.when((v < lo) & (v > lo - r), 1 - (lo - v) / r).when((v > hi) & (v < hi + r), 1 - (v - hi) / r)
    return df.select(row_id, weight.otherwise(0.0).alias("weight")).where("weight > 0")


def angular_brush(df: DataFrame, left: str, right: str, lo: float, hi: float, step: float = 1.0, mode: str = "min_max", row_id: str = "row_id") -> DataFrame:
    """Weight 1 for rows whose line between two scaled axes, ``step`` apart, has a slope in [lo, hi]."""
    slope = (F.col(left) - F.col(right)) / step
    return scaled(df, [left, right], mode).where(slope.between(lo, hi)).select(row_id, F.lit(1.0).alias("weight"))


def correlation_brush(df: DataFrame, left: str, right: str, lo: float, hi: float, mode: str = "min_max", row_id: str = "row_id") -> DataFrame:
    """Weight 1 for rows whose scaled values differ by lo to hi."""
    return angular_brush(df, left, right, lo, hi, 1.0, mode, row_id)


def combine(a: DataFrame, b: DataFrame, how: str, row_id: str = "row_id") -> DataFrame:
    """Fuzzy set operations: "add" min(1, a + b), "subtract" max(0, a - b), "intersect" min(a, b); rows of weight 0 are left out."""
    x, y = a.select(row_id, F.col("weight").alias("_a")), b.select(row_id, F.col("weight").alias("_b"))
    kind = {"add": "full", "subtract": "left", "intersect": "inner"}.get(how)
    if not kind:
        raise ValueError(f"unknown operation {how!r}; add, subtract or intersect")
    p, q = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    weight = {"add": F.least(F.lit(1.0), p + q), "subtract": F.greatest(F.lit(0.0), p - q), "intersect": F.least(p, q)}[how]
    return x.join(y, row_id, kind).select(row_id, weight.alias("weight")).where("weight > 0")


def combine_all(first: DataFrame, steps: list[tuple[str, DataFrame]], row_id: str = "row_id") -> DataFrame:
    """Any number of set operations, one after another as ``combine`` has them, in one shuffle.

    The brushes' rows are put together with their place and grouped by row; the
    operations then follow one another in each row. Of rows that a brush holds
    more than once the greatest weight counts.
    """
    for how, _ in steps:
        if how not in ("add", "subtract", "intersect"):
            raise ValueError(f"unknown operation {how!r}; add, subtract or intersect")
    brushes = [first, *(b for _, b in steps)]
    together = brushes[0].select(row_id, "weight", F.lit(0).alias("_place"))
    for i, b in enumerate(brushes[1:], 1):
        together = together.unionByName(b.select(row_id, "weight", F.lit(i).alias("_place")))
    by_row = together.groupBy(row_id).agg(*[F.coalesce(F.max(F.when(F.col("_place") == i, F.col("weight"))), F.lit(0.0)).alias(f"_{i}") for i in range(len(brushes))])
    weight = F.col("_0")
    for i, (how, _) in enumerate(steps, 1):
        w = F.col(f"_{i}")
        weight = {"add": F.least(F.lit(1.0), weight + w), "subtract": F.greatest(F.lit(0.0), weight - w), "intersect": F.least(weight, w)}[how]
    return by_row.select(row_id, weight.alias("weight")).where("weight > 0")


def axis_histogram(df: DataFrame, column: str, bins: int = 10, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, low, high, count) of equal bins from least to greatest value, the greatest in the last bin; empty bins are there."""
    if lo is None or hi is None:
        b = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
        lo, hi = b[0] if lo is None else lo, b[1] if hi is None else hi
    if lo is None or hi is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    size = (hi - lo) / bins
    x = F.col(column).cast("double")
    place = F.least(F.floor((x - lo) / size), F.lit(bins - 1)).cast("int") if size else F.lit(0)
    counts = df.where(x.between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(F.broadcast(counts), "bin", "left").select("bin", (lo + F.col("bin") * size).alias("low"), (lo + (F.col("bin") + 1) * size).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


BASES = ("total", "fullest", "fullest_brushed")


def histogram_widths(df: DataFrame, column: str, brush: DataFrame | None = None, base: str = "total", bins: int = 10, row_id: str = "row_id") -> DataFrame:
    """(bin, low, high, count, brushed, width, brushed_width): an axis histogram with the brushed weight in each bin.

    Widths are counts over a base: all rows, the fullest bin, or the fullest brushed
    bin; without rows there they are 0.
    """
    if base not in BASES:
        raise ValueError(f"unknown base {base!r}; one of {', '.join(BASES)}")
    b = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    out = axis_histogram(df, column, bins, *b)
    if b[0] is None:
        return out.selectExpr("*", "0D brushed", "0D width", "0D brushed_width")
    size, x = (b[1] - b[0]) / bins, F.col(column).cast("double")
    place = F.least(F.floor((x - b[0]) / size), F.lit(bins - 1)).cast("int") if size else F.lit(0)
    if brush is not None:
        weights = df.where(x.isNotNull()).select(row_id, place.alias("bin")).join(brush.select(row_id, "weight"), row_id).groupBy("bin").agg(F.sum("weight").alias("brushed"))
        out = out.join(F.broadcast(weights), "bin", "left")  # a row per bin
    out = out.withColumn("brushed", F.coalesce("brushed", F.lit(0.0)) if brush is not None else F.lit(0.0))
    by = {"total": F.sum("count"), "fullest": F.max("count"), "fullest_brushed": F.max("brushed")}[base]
    whole = F.broadcast(out.agg(by.cast("double").alias("whole")))  # one row
    over = lambda c: F.when(F.col("whole") > 0, F.col(c) / F.col("whole")).otherwise(0.0)
    return out.join(whole).select("bin", "low", "high", "count", "brushed", over("count").alias("width"), over("brushed").alias("brushed_width"))


def records(df: DataFrame, label: str = "label") -> DataFrame:
    """One record per row: numeric columns as float, all text joined into a label, a line per column."""
    from ..sources.schema import numeric_columns

    numbers = numeric_columns(df.schema)
    texts = [c for c in df.columns if c not in numbers]
    return df.select(*[F.col(c).cast("float").alias(c) for c in numbers], F.concat_ws("\n", *[F.col(c).cast("string") for c in texts]).alias(label))


def value_labels(df: DataFrame, column: str, labels: dict[float, str], to: str = "label") -> DataFrame:
    """Texts for the values of one axis; other values keep their own text."""
    made = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (float(k), v)]) if labels else None
    own = F.col(column).cast("string")
    return df.withColumn(to, F.coalesce(made[F.col(column).cast("double")], own) if labels else own)
