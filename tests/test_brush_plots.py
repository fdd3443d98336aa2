
import random

import pytest
from pyspark.sql import functions as F

from statweave.functions import vectors
from statweave.operators import brush, plots
from statweave.sources import tables


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, float(i), float(-i)) for i in range(11)], "row_id long, x double, y double")


def pairs(brush_df):
    return {r["row_id"]: round(r["weight"], 6) for r in brush_df.collect()}


def test_scales(spark, df):
    got = {m: {r["column"]: (r["offset"], r["scale"]) for r in brush.axis_scale(df, ["x", "y"], m).collect()} for m in brush.SCALES}
    assert got["min_max"] == {"x": (0.0, 10.0), "y": (-10.0, 10.0)}
    assert got["zero_max"] == {"x": (0.0, 10.0), "y": (0.0, 0.0)}
    assert got["global"] == {"x": (-10.0, 20.0), "y": (-10.0, 20.0)}
    assert [r.x for r in brush.scaled(df, ["x"]).orderBy("row_id").limit(2).collect()] == [0.0, 0.1]


def test_ranges_and_brushes(spark, df, tmp_path):
    assert brush.range_count(df, "x", 2, 5).first()[0] == 3
    soft = brush.soft_brush(df, "x", 4, 6, 2.0)
    assert pairs(soft) == {3: 0.5, 4: 1, 5: 1, 6: 1, 7: 0.5}
    assert brush.brushed_count(df, soft, "x", 3, 6).first()[0] == 2
    other = brush.soft_brush(df, "x", 7, 8, 0.0)
    assert pairs(brush.combine(soft, other, "add")) == {3: 0.5, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    assert pairs(brush.combine(soft, other, "subtract")) == {3: 0.5, 4: 1, 5: 1, 6: 1}
    assert pairs(brush.combine(soft, other, "intersect")) == {7: 0.5}
    with pytest.raises(ValueError):
        brush.combine(soft, other, "xor")
    assert set(pairs(brush.angular_brush(df, "x", "y", -0.2, 0.2))) == {4, 5, 6}
    tables.write_brush(soft, str(tmp_path / "b"), "mine")
    name, again = tables.read_brush(spark, str(tmp_path / "b"))
    assert name == "mine" and sorted(map(tuple, again.collect())) == sorted(map(tuple, soft.collect()))


def test_many_brushes_as_pairs_of_them(spark, df):
    rng = random.Random(3)
    for _ in range(4):
        made = [brush.soft_brush(df, "x", a := rng.uniform(0, 8), a + rng.uniform(0, 4), rng.uniform(0, 3)) for _ in range(6)]
        steps = [(rng.choice(["add", "subtract", "intersect"]), b) for b in made[1:]]
        one = made[0]
        for how, b in steps:
            one = brush.combine(one, b, how)
        assert pairs(brush.combine_all(made[0], steps)) == pairs(one)
    assert pairs(brush.combine_all(made[0], [])) == pairs(made[0])
    with pytest.raises(ValueError):
        brush.combine_all(made[0], [("xor", made[1])])


def test_histograms_of_columns(spark, df):
    odd = df.withColumns({"none": F.lit(None).cast("double"), "same": F.lit(2.5), "holes": F.when(F.col("x") > 4, F.col("x"))})
    got = plots.frequencies_histogram(odd, ["x", "none", "same", "holes"], bins=4).orderBy("column", "bin").collect()
    assert [(r.column, r.bin, r["count"]) for r in got] == [("holes", 0, 2), ("holes", 1, 1), ("holes", 2, 1), ("holes", 3, 2), ("same", 0, 11), ("same", 1, 0), ("same", 2, 0), ("same", 3, 0), ("x", 0, 3), ("x", 1, 2), ("x", 2, 3), ("x", 3, 3)]
    assert plots.frequencies_histogram(odd, ["none"]).count() == 0 and plots.frequencies_histogram(df.select("row_id").limit(0), ["row_id"]).count() == 0


def test_histogram_and_records(spark, df):
    h = brush.axis_histogram(df, "x").orderBy("bin").collect()
    assert [r["count"] for r in h] == [1] * 9 + [2] and h[0]["low"] == 0.0 and h[-1]["high"] == 10.0
    assert brush.axis_histogram(df.where("false"), "x").count() == 0
    assert brush.axis_histogram(df.where("x = 3"), "x").agg(F.sum("count")).first()[0] == 1
    r = brush.records(spark.createDataFrame([(1, "a", "b")], "n int, s string, t string")).first()
    assert (r["n"], r["label"]) == (1.0, "a\nb")
    named = brush.value_labels(df, "x", {1.0: "one"}).orderBy("row_id").limit(2).collect()
    assert [n["label"] for n in named] == ["0.0", "one"]


def test_plots(spark, df):
    assert tuple(plots.box_plot(df, ["x"]).first()) == ("x", 0.0, 2.5, 5.0, 7.5, 10.0)
    s = plots.view_table("scatter-plot", df.repartition(3), order=["row_id"], columns=["x"]).orderBy("index").collect()
    assert [(r["index"], r["value"]) for r in s] == [(i, float(i)) for i in range(11)]
    with pytest.raises(ValueError):
        plots.scatter_3d(df, ["x"])
    p = spark.createDataFrame([("OUTLIER-1", [1.0, 2.0, 3.0]), ("0", [4.0, 5.0, 6.0])], "cluster string, point array<double>")
    assert plots.cluster_plots(p, ["a", "b", "c"], 3)["a", "b", "c"].count() == 1
    assert len(plots.cluster_plots(p, ["a", "b", "c"])) == 3
    assert plots.view_table("parallel-lines", df, sample=1.0, seed=1, columns=["x", "y"]).count() == 11


def test_distances(spark):
    d = spark.createDataFrame([([0.0, 0.0, 1.0], [3.0, 4.0, 1.0])], "a array<double>, b array<double>")
    a, b, dims = F.col("a"), F.col("b"), F.array(F.lit(1), F.lit(2))
    assert tuple(d.select(vectors.euclidean(a, b), vectors.manhattan(a, b), vectors.segmental(a, dims, b), vectors.build_distance("?")(a, b)).first()) == (5.0, 7.0, 4.0, 5.0)
