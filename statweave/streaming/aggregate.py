"""Calendar aggregation of a stream: the tumbling-window form of ``timeseries.aggregate``.

Periods are those of the session's time zone, as in batches.  In UTC days and weeks
have a fixed length and close with the watermark.  Months and years, and days and
weeks of zones whose clocks change, have none, so their groups are kept by their
start and need the "update" or "complete" output mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsing import bucket

#: Names of the zone that is free of clock changes and offsets.
UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
FUNCTIONS = {"average": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def aggregate_stream(stream: DataFrame, column: str, value: str, period: str, function: str, lateness: str = "1 day") -> DataFrame:
    """(bucket, value, count) of a stream's ``value`` by the calendar period of its timestamp ``column``."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function {function!r}; one of {', '.join(FUNCTIONS)}")
    timed = stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)
    made = [FUNCTIONS[function](value).alias("value"), F.count(value).alias("count")]
    if period in ("day", "week") and stream.sparkSession.conf.get("spark.sql.session.timeZone") in UTC:
        # Windows of 7 days begin on Thursdays, as 1970 did; Mondays are 4 days later.
        window = F.window(column, "1 day") if period == "day" else F.window(column, "7 days", startTime="4 days")
        return timed.groupBy(window.alias("w")).agg(*made).select(F.col("w.start").alias("bucket"), "value", "count")
    return timed.groupBy(bucket(F.col(column), period).alias("bucket")).agg(*made)


def write_stream(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append closed periods to a Parquet folder; all input that is there, then end."""
    return result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
