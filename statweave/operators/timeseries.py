"""Time series: order, calendar aggregation, stationarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import bucket, number, parse_date_time
from ..sources.schema import DATE_TIME, DOUBLE, LONG, NUMERIC, field_of, kind_of

FUNCTIONS = ("average", "max", "min", "sum")


def instant(df: DataFrame, column: str) -> Column:
    """The instant of a date-time column; any other column is an error."""
    f = field_of(df.schema, column)
    if kind_of(f) != DATE_TIME:
        raise ValueError(f"column {column!r} is no date-time but {kind_of(f)}")
    return parse_date_time(df[f.name], f)


def sort(df: DataFrame, column: str) -> DataFrame:
    """Rows in the order of a date-time column; those without a readable date are left out."""
    return df.withColumn("_at", instant(df, column)).where("_at is not null").orderBy("_at").drop("_at")


def aggregate(df: DataFrame, column: str, period: str, function: str, preserve_types: bool = True, week_start: str = "monday") -> DataFrame:
    """One row per calendar period.

    Numeric columns get the function's value (nulls don't count), others the value
    of the earliest row that has one (the least of equally early ones), the date
    column the period's first instant.
    ``preserve_types``: results have the column's type, so integer averages are
    cut towards zero; sums of whole numbers are long and others double, as they may
    leave the column's type. A sum beyond a long is an error.
    """
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function {function!r}; one of {', '.join(FUNCTIONS)}")
    date = field_of(df.schema, column).name
    when = instant(df, column)
    at = bucket(when, period, week_start)
    when, made = when.alias("when"), []
    for f in df.schema.fields:
        if f.name == date:
            continue
        c = F.col(f.name)
        if kind_of(f) not in NUMERIC:
            value = F.min(F.when(c.isNotNull(), F.struct(when, c.alias("value"))))["value"]
        elif function == "average":
            whole = preserve_types and isinstance(f.dataType, T.IntegralType)
            value = F.expr(f"sum(`{f.name}`) div nullif(count(`{f.name}`), 0)") if whole else F.avg(c)
        else:
            value = {"max": F.max, "min": F.min, "sum": F.sum}[function](c)
        meta = f.metadata
        if kind_of(f) in NUMERIC:
            if function == "sum":  # Spark's sum has the wide type already
                whole = isinstance(f.dataType, T.IntegralType)
                meta = {**meta, "kind": LONG if whole else DOUBLE} if "kind" in meta else meta
                value = value if whole or isinstance(f.dataType, T.DecimalType) else value.cast("double")
            elif preserve_types:
                value = value.cast(f.dataType)
        made.append(value.alias(f.name, metadata=meta))
    out = df.withColumn("_at", at).where("_at is not null").groupBy("_at").agg(*made) if made else df.select(at.alias("_at")).where("_at is not null").distinct()
    return out.select(*[F.col("_at").alias(date, metadata={"kind": DATE_TIME}) if f.name == date else F.col(f.name) for f in df.schema.fields])


def stationarity(df: DataFrame, column: str, date_column: str, period: str, week_start: str = "monday") -> DataFrame:
    """(date, average, variance, minimum, maximum) of one column in each calendar period; variance of the population."""
    f = field_of(df.schema, column)
    x = number(df[f.name], f)
    if x is None:
        raise ValueError(f"column {column!r} is text")
    rows = df.select(bucket(instant(df, date_column), period, week_start).alias("date"), x.alias("x")).where("date is not null and x is not null")
    return rows.groupBy("date").agg(F.avg("x").alias("average"), F.var_pop("x").alias("variance"), F.min("x").alias("minimum"), F.max("x").alias("maximum"))


def stationarity_summary(report: DataFrame) -> DataFrame:
    """One row: avg_var and var_var, the sample variances of the periods' averages and variances."""
    return report.agg(F.var_samp("average").alias("avg_var"), F.var_samp("variance").alias("var_var"))
