"""Descriptive statistics; each operator is one scan with partial aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import number
from ..sources.schema import field_of, numeric_columns
from ..sources.storage import Stored


def _column(df: DataFrame, name: str) -> Column | None:
    f = field_of(df.schema, name)
    return number(df[f.name], f)


def centrality(df: DataFrame, column: str) -> DataFrame:
    """avg, min, max and count of the values that are there, as doubles; text columns have none of them."""
    x = _column(df, column)
    if x is None:
        x = F.lit(None).cast("double")
    return df.agg(F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).cast("double").alias("count"))


def dispersion(df: DataFrame, column: str, average: float) -> DataFrame:
    """Mean squared distance from a given average, and its root."""
    x = _column(df, column)
    if x is None:
        x = F.lit(None).cast("double")
    away = F.lit(float(average)) - x
    return df.agg(F.avg(away * away).alias("var")).select("var", F.sqrt("var").alias("stdev"))


def frequency_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of each value that occurs, in order."""
    x = _column(df, column)
    if x is None:
        return df.sparkSession.createDataFrame([], "value double, count double")
    return df.select(x.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").cast("double").alias("count")).orderBy("value")


def frequency_distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) of each value of the numeric columns, in the order of columns and values: one scan and one count for all of them."""
    names = columns if columns is not None else numeric_columns(df.schema)
    pairs = [F.when(x.isNotNull(), F.struct(F.lit(i).alias("place"), x.alias("value"))) for i, x in enumerate(_column(df, c) for c in names) if x is not None]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, value double, count double")
    counts = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("at")).groupBy("at.place", "at.value").agg(F.count("*").cast("double").alias("count"))
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("place"))
    return counts.orderBy("place", "value").select(name.alias("column"), "value", "count")


def table_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per numeric column: column, average, min, max, variance (of the population), standard_deviation."""
    names = columns if columns is not None else numeric_columns(df.schema)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, average double, min double, max double, variance double, standard_deviation double")
    parts = []
    for name in names:
        x = _column(df, name)
        x = F.lit(None).cast("double") if x is None else x
        stats = F.struct(
            F.lit(name).alias("column"), F.avg(x).alias("average"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("standard_deviation"),
        )
        parts.append(stats)
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


#: Distinct values of a column up to which one task may gather them for its quantiles.
GATHER = 100_000


def quantiles(df: DataFrame, column: str, probabilities: list[float], gather: int = GATHER) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls don't count, and an empty column has none.

    Up to ``gather`` distinct values (estimated) one aggregate keeps them all.
    Beyond that values are counted, put in order and stored by ranges; the ranges'
    totals say which of them hold the ranks in question, and only those are read again.
    """
    x = _column(df, column)
    if x is None:
        raise ValueError(f"column {column!r} is text")
    values = df.select(x.alias("x")).where("x is not null")
    if (values.agg(F.approx_count_distinct("x")).first()[0] or 0) <= gather:
        return values.agg(F.percentile("x", probabilities)).first()[0] or [None] * len(probabilities)
    held = Stored(values.groupBy("x").agg(F.count("*").alias("n")).orderBy("x").withColumn("part", F.spark_partition_id()))
    ranged, before, total = held.df, {}, 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect()):  # a row per range
        before[part] = total, total + n
        total += n
    ranks = sorted({r for p in probabilities for r in (math.floor((total - 1) * p), math.ceil((total - 1) * p))})
    holds = {part: [r for r in ranks if a <= r < z] for part, (a, z) in before.items()}
    start = F.create_map(*[F.lit(v) for part, inside in holds.items() if inside for v in (part, before[part][0])])  # a few ranges
    upto = start[F.col("part")] + F.sum("n").over(W.partitionBy("part").orderBy("x"))
    rows = ranged.where(F.col("part").isin([part for part, inside in holds.items() if inside])).select("x", "n", upto.alias("upto"))
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    found = [tuple(r) for r in rows.where(hit).collect()]  # a row per rank at most
    at = {r: next(x for x, n, u in found if u - n <= r < u) for r in ranks}
    held.drop()
    out = []
    for p in probabilities:
        h = (total - 1) * p
        lo, hi = at[math.floor(h)], at[math.ceil(h)]
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def sample_variance(df: DataFrame, column: str) -> DataFrame:
    """Variance with n - 1."""
    return df.agg(F.var_samp(column).alias("variance"))


def axis_bounds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max) of each numeric column."""
    return table_stats(df, columns).select("column", "min", "max")
