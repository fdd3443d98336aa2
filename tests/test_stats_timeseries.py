import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statweave.operators import rows, stats, timeseries
from statweave.plans.jobs import job_info, run_job
from statweave.sources import schema as S
from statweave.streaming.aggregate import aggregate_stream, write_stream

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(i,) for i in range(1, 11)], S.def_schema("vals", S.INTEGER))


def test_centrality_and_dispersion(spark, ten):
    c = run_job(spark, "centrality-stats", table=ten, column="vals").output().first()
    assert (c["min"], c["max"], c["avg"], c["count"]) == (1, 10, 5.5, 10)
    d = run_job(spark, "dispersion-stats", table=ten, column="vals", average=c["avg"]).output().first()
    assert d["var"] == 8.25 and 2 < d["stdev"] < 3
    assert run_job(spark, "table-stats", table=ten).output().first()[1:5] == (5.5, 1.0, 10.0, 8.25)


def test_nulls_text_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b")], "x int, s string")
    assert tuple(stats.centrality(df, "x").first()) == (2.0, 2.0, 2.0, 1.0)
    assert tuple(stats.centrality(df, "s").first()) == (None, None, None, 0.0)
    assert stats.frequency_distribution(df, "s").count() == 0
    empty = df.where("false")
    assert tuple(stats.centrality(empty, "x").first()) == (None, None, None, 0.0)
    assert stats.table_stats(df.select("s")).count() == 0


def test_frequencies(spark, ten):
    f = run_job(spark, "frequency-distribution", table=ten, column="vals").output().collect()
    assert [tuple(r) for r in f] == [(float(i), 1.0) for i in range(1, 11)]


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=30))
def test_frequencies_add_up(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    total = stats.frequency_distribution(df, "x").agg(F.coalesce(F.sum("count"), F.lit(0.0))).first()[0]
    assert total == sum(x is not None for x in xs)


@FEW
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=20))
def test_normalized_values_lie_between_0_and_1(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in rows.normalize(df, ["x"], [min(xs)], [max(xs)]).collect()]
    assert len(got) == len(xs) and (min(xs) == max(xs) or all(0 <= g <= 1 for g in got))


@pytest.mark.parametrize("gather", [10**6, 0])
def test_quantiles_are_exact_either_way(spark, gather):
    xs = [float((i * 7919) % 503) for i in range(700)] + [None] * 5
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(3)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert stats.quantiles(df, "x", at, gather) == pytest.approx(np.quantile([x for x in xs if x is not None], at).tolist())
    assert stats.quantiles(df.where("false"), "x", at) == [None] * 5


def test_sort_leaves_out_unreadable_dates(spark):
    s = S.def_schema("at", S.DATE_TIME, "x", S.INTEGER, date_formats={"at": "yyyy-MM-dd"})
    df = spark.createDataFrame([("2020-03-01", 3), ("bad", 0), (None, 9), ("2020-01-01", 1), ("2020-02-01", 2)], s)
    assert [r.x for r in timeseries.sort(df, "at").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        timeseries.sort(df, "x")


def test_aggregate_keeps_types_and_first_values(spark):
    d = lambda *a: dt.datetime(*a)
    df = spark.createDataFrame([(d(2020, 1, 1, 1), 1, None, 1.0), (d(2020, 1, 1, 23), 2, "b", None), (d(2020, 1, 2), -3, None, 4.0), (d(2020, 1, 2, 1), -4, None, 6.0)], "at timestamp, n int, s string, x double")
    out = run_job(spark, "time-series-aggregate", table=df, column="at", period="day", aggregation_function="average").output()
    assert out.columns == df.columns and dict(out.dtypes)["n"] == "int"
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(-3, None, 5.0), (1, "b", 1.0)]
    assert sorted(r.n for r in timeseries.aggregate(df, "at", "day", "average", preserve_types=False).collect()) == [-3.5, 1.5]
    for period in ("day", "week", "month", "year"):
        assert sum(r.n for r in timeseries.aggregate(df, "at", period, "sum").collect()) == -4
    for bad in (("hour", "sum"), ("day", "median")):
        with pytest.raises(ValueError):
            timeseries.aggregate(df, "at", *bad)


def test_week_starts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7), 1)], "at timestamp, n int")  # a Sunday
    start = lambda w: timeseries.aggregate(df, "at", "week", "sum", week_start=w).first()["at"].day
    assert (start("monday"), start("sunday")) == (1, 8)


def test_stationarity(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, d), float(x)) for d, x in ((1, 1), (1, 3), (2, 5), (2, 9))], "at timestamp, x double")
    job = run_job(spark, "time-series-stationality", table=df, column="x", date_column="at", period="day")
    assert sorted(tuple(r)[1:] for r in job.output("table").collect()) == [(2.0, 1.0, 1.0, 3.0), (7.0, 4.0, 5.0, 9.0)]
    assert tuple(job.output("summary").first()) == (12.5, 4.5)


def test_outputs_are_written_and_replaced(spark, ten, tmp_path):
    for _ in range(2):
        job = run_job(spark, "filter-table", table=ten, filter_function="vals > 7", output_path=str(tmp_path / "o"))
    assert spark.read.parquet(job.output_path()).count() == 3
    assert run_job(spark, "table-count-lines", table=job.output_path()).output().first()[0] == 3
    assert "filter-table" in job_info("filter-table")


def test_stream_agrees_with_batch(spark, tmp_path):
    data = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for period in ("day", "week"):
        q = write_stream(aggregate_stream(stream, "ts", "value", period, "sum"), str(tmp_path / period), str(tmp_path / f"c{period}"))
        q.awaitTermination(60)
        closed = {r["bucket"]: r["value"] for r in spark.read.parquet(str(tmp_path / period)).collect()}
        batch = {r["ts"]: r["value"] for r in timeseries.aggregate(df, "ts", period, "sum").collect()}
        assert closed and all(batch[k] == v for k, v in closed.items())


def test_sums_may_leave_the_type_of_their_column(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 2_000_000_000, 3.0e38), (dt.datetime(2024, 1, 1), 2_000_000_000, 3.0e38)], "t timestamp, n int, x float")
    out = timeseries.aggregate(df, "t", "day", "sum")
    assert (out.first().n, out.dtypes[1][1], out.dtypes[2][1]) == (4_000_000_000, "bigint", "double") and out.first().x > 5.9e38
    kept = timeseries.aggregate(df, "t", "day", "average")
    assert kept.first().n == 2_000_000_000 and kept.dtypes[1][1] == "int"


def test_streams_cut_days_and_weeks_as_batches_do_in_any_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(0, 24 * 20, 5).select((F.lit(1709856000) + F.col("id") * 3600).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value"))  # a clock change inside
        df.write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        for period in ("day", "week"):
            q = aggregate_stream(stream, "ts", "value", period, "sum").writeStream.format("memory").queryName(f"zoned_{period}").outputMode("complete").trigger(availableNow=True).start()
            q.awaitTermination(60)
            got = sorted((r.bucket, r.value) for r in spark.table(f"zoned_{period}").collect())
            assert got == sorted((r.ts, r.value) for r in timeseries.aggregate(df, "ts", period, "sum").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
