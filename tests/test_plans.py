"""Physical plans: what is pushed into scans, how often tables are read, what shuffles."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from statweave.operators import brush, plots, rows, stats, timeseries


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    data = [(i, float(i % 7), f"s{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(200)]
    spark.createDataFrame(data, "id long, x double, s string, at timestamp").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"\b{node}\b", plan(df)))


def scanned(df):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", plan(df))[1]))


def test_statistics_are_one_scan_of_the_columns_they_need(table):
    df = stats.table_stats(table)
    assert count(df, "FileScan") == 1 and count(df, "Exchange") == 1 and scanned(df) == {"id", "x"}
    assert scanned(stats.centrality(table, "x")) == {"x"}
    assert scanned(rows.count_lines(table).select("count")) <= {"id"} or "ReadSchema: struct<>" in plan(rows.count_lines(table))


def test_filters_reach_the_scan(table):
    df = rows.filter_table(table, "x > 3").select("id")
    assert "GreaterThan(x,3.0)" in plan(df) and scanned(df) == {"id", "x"} and count(df, "Exchange") == 0


def test_row_operators_do_not_shuffle(table):
    for df in (
        rows.vectorize(table, ["x", "id"]), rows.normalize(table, ["x"], [0], [6]), rows.sample_bernoulli(table, 0.5, 1),
        rows.map_table(table, {"y": F.col("x") * 2}), brush.soft_brush(table, "x", 1, 2, row_id="id"),
    ):
        assert count(df, "Exchange") == 0


def test_aggregates_are_partial_before_the_shuffle(table):
    for df in (timeseries.aggregate(table.select("at", "x"), "at", "day", "sum"), timeseries.stationarity(table, "x", "at", "week")):
        assert count(df, "Exchange") == 1 and plan(df).count("HashAggregate") == 2 and scanned(df) == {"at", "x"}


def test_histograms_and_frequencies_of_all_columns_are_one_scan(spark, table, monkeypatch):
    many = table.withColumns({"y": F.col("x") * 2, "z": -F.col("x")})
    names = ["id", "x", "y", "z"]
    assert count(stats.frequency_distributions(many, names), "FileScan") == 1
    plan_of = plan(plots.frequencies_histogram(many, names))
    assert len(re.findall("FileScan", plan_of)) == 1 and "partial_count" in plan_of  # and one more for the bounds
    assert plots.frequencies_histogram(table, ["id"]).agg(F.sum("count")).first()[0] == 200


def test_ten_brushes_are_one_shuffle(spark, table):
    brushes = [brush.soft_brush(table, "x", k, k + 1, row_id="id") for k in range(10)]
    together = brush.combine_all(brushes[0], [(("add", "subtract", "intersect")[k % 3], b) for k, b in enumerate(brushes[1:])], "id")
    assert count(together, "Exchange") == 1 and count(together, "SortMergeJoin") == 0


def test_functions_of_many_rows_are_one_arrow_node(table):
    f = rows.arrow_function(lambda b: [True] * b.num_rows)
    for df in (rows.filter_table(table, f), rows.map_table(table, rows.arrow_function(lambda b: b)), rows.vectorize(table, rows.pandas_function(lambda p: [[1.0]] * len(p)), keep=["id"])):
        assert count(df, "MapInArrow") == 1 and count(df, "Exchange") == 0 and "BatchEvalPython" not in plan(df)
