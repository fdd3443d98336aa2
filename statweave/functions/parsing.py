"""Columns that parse text cells and turn values into numbers.

A cell that can't be parsed is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import CATEGORICAL, DATE_TIME, STRING, TYPES, kind_of

NULLS = ("", "NULL")
PERIODS = ("day", "week", "month", "year")


def null_if_token(cell: Column, nulls: tuple[str, ...] = NULLS) -> Column:
    """Null where the cell without its spaces equals one of the tokens in any case."""
    return F.when(F.upper(F.replace(cell, F.lit(" "), F.lit(""))).isin(*[n.replace(" ", "").upper() for n in nulls]), F.lit(None)).otherwise(cell)


def parse_datum(cell: Column, kind: str) -> Column:
    """A text cell as a value of its kind; numbers may hold spaces anywhere."""
    if kind in (STRING, CATEGORICAL, DATE_TIME):
        return cell
    return F.replace(cell, F.lit(" "), F.lit("")).try_cast(TYPES[kind])


def parse_date_time(c: Column, field: T.StructField) -> Column:
    """The instant of a date-time column: text by the field's format, numbers as milliseconds since 1970."""
    t = field.dataType
    if isinstance(t, T.StringType):
        return F.try_to_timestamp(c, F.lit((field.metadata or {}).get("format", "yyyy-MM-dd HH:mm:ss")))
    if isinstance(t, T.NumericType):
        return F.timestamp_millis(c.cast("long"))
    return c.cast("timestamp")


def number(c: Column, field: T.StructField) -> Column | None:
    """The column as double: date-times as milliseconds, numbers as they are; None for text."""
    kind = kind_of(field)
    if kind in (STRING, CATEGORICAL):
        return None
    if kind == DATE_TIME:
        return F.unix_millis(parse_date_time(c, field)).cast("double")
    return c.cast("double")


def bucket(ts: Column, period: str, week_start: str = "monday") -> Column:
    """The start of the calendar period that holds an instant. Weeks begin on Monday; "sunday" assigns a Sunday to the next Monday's week."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; one of {', '.join(PERIODS)}")
    if week_start not in ("monday", "sunday"):
        raise ValueError(f"unknown start of a week {week_start!r}")
    if period == "week" and week_start == "sunday":
        ts = ts + F.expr("INTERVAL 1 DAY")
    return F.date_trunc(period.upper(), ts)
