"""Queries over the steps of clustering, brushes and plots: each phase on stated inputs, held against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import proclus as proclus_command_line
from ..functions import vectors
from ..operators import brush, plots, rows, timeseries
from ..operators.clustering import canopy, common, dirichlet, kmeans, proclus
from ..sources.storage import Scratch
from .queries import _MEANS, _STATIONARITY, _label_means, _points, canopy_sql, plain_time, proclus_sql, query, rounded, table

#: Medoids of the phases of projected clustering: these vectors, each with three dimensions.
MEDOIDS = range(5)
DIMS = [np.array([k, k + 1, k + 7]) for k in MEDOIDS]

_BASE = """
e AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT vec_id AS k, i, x AS c FROM e WHERE vec_id < 5),
delta AS (SELECT k, min(d) AS delta FROM (SELECT a.k, b.k AS o, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM m a JOIN m b ON a.i = b.i AND a.k <> b.k GROUP BY 1, 2) GROUP BY 1)"""
_SEGMENTAL = f"""{_BASE},
seg AS (SELECT vec_id, k, sum(abs(x - c)) AS d FROM e JOIN m ON e.i = m.i AND m.i IN (k, k + 1, k + 7) GROUP BY 1, 2),
own AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM seg GROUP BY 1)"""
_LOCAL = """
inside AS (SELECT vec_id, m.k FROM e JOIN m ON e.i = m.i GROUP BY 1, 2 HAVING sqrt(sum((x - c) * (x - c))) <= (SELECT delta FROM delta WHERE delta.k = m.k)),
means AS (SELECT m.k, m.i, avg(abs(x - c)) AS mean FROM inside JOIN m ON m.k = inside.k JOIN e ON e.vec_id = inside.vec_id AND e.i = m.i GROUP BY 1, 2)"""


def _medoids(spark, sf) -> np.ndarray:
    some = _points(spark, sf).where("vec_id < 5").select("vec_id", "point").collect()  # five rows
    return np.array([r["point"] for r in sorted(some)])


def _matrix(spark, x: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(x) for i, v in enumerate(row)], f"k long, i long, {name} double")


@query(f"WITH {_BASE} SELECT k, round(delta, 6) AS delta FROM delta")
def proclus_radii(spark, sf):
    return spark.createDataFrame([(k, round(float(d), 6)) for k, d in enumerate(proclus.radii(_medoids(spark, sf)))], "k long, delta double")


@query(f"WITH {_BASE}, {_LOCAL} SELECT k, i, round(mean, 6) AS mean FROM means")
def proclus_localities(spark, sf):
    m = _medoids(spark, sf)
    return rounded(_matrix(spark, proclus.locality_means(_points(spark, sf), m, proclus.radii(m)), "mean"), 6)


_Z = """
z AS (SELECT k, i, (mean - avg(mean) OVER (PARTITION BY k)) / stddev_samp(mean) OVER (PARTITION BY k) AS z FROM means),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY z, i) AS r FROM z),
rest AS (SELECT *, row_number() OVER (ORDER BY z, k, i) AS q FROM o WHERE r > 2),
chosen AS (SELECT k, i FROM o WHERE r <= 2 UNION ALL SELECT k, i FROM rest WHERE q <= 5 * (4 - 2))"""


@query(f"WITH {_BASE}, {_LOCAL}, {_Z} SELECT k, i FROM chosen")
def proclus_dimensions(spark, sf):
    """The least weights: two for each medoid, then the least of all up to four on average."""
    m = _medoids(spark, sf)
    chosen = proclus.select_dimensions(proclus.locality_means(_points(spark, sf), m, proclus.radii(m)), 4)
    return spark.createDataFrame([(k, int(i)) for k, dims in enumerate(chosen) for i in dims], "k long, i long")


_OWN_LOCAL = """
inside AS (SELECT e.vec_id, m.k FROM e JOIN m ON e.i = m.i JOIN own ON own.vec_id = e.vec_id AND own.k = m.k GROUP BY 1, 2
  HAVING sqrt(sum((x - c) * (x - c))) <= (SELECT delta FROM delta WHERE delta.k = m.k)),
means AS (SELECT m.k, m.i, avg(abs(x - c)) AS mean FROM inside JOIN m ON m.k = inside.k JOIN e ON e.vec_id = inside.vec_id AND e.i = m.i GROUP BY 1, 2)"""


@query(f"WITH {_SEGMENTAL}, {_OWN_LOCAL} SELECT k, i, round(mean, 6) AS mean FROM means")
def proclus_refinement(spark, sf):
    """Means over a medoid's locality and cluster."""
    m = _medoids(spark, sf)
    return rounded(_matrix(spark, proclus.locality_means(_points(spark, sf), m, proclus.radii(m), DIMS), "mean"), 6)


@query(f"WITH {_SEGMENTAL} SELECT vec_id, k::INTEGER AS cluster, round(d, 6) AS d FROM own")
def proclus_assignment(spark, sf):
    m = _medoids(spark, sf)
    points = common.assign(_points(spark, sf), lambda x: proclus.segmental(x, m, DIMS).argmin(1))
    near = common.assign(points, lambda x: proclus.segmental(x, m, DIMS).min(1), T.DoubleType(), "d")
    return rounded(near.select("vec_id", "cluster", "d"), 6)


@query(f"""WITH {_SEGMENTAL},
w AS (SELECT own.k, count(DISTINCT e.vec_id) AS n, avg(abs(x - c)) AS w FROM own JOIN e ON e.vec_id = own.vec_id JOIN m ON m.k = own.k AND m.i = e.i GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(w / 5 * n) / sum(n) AS objective FROM w)
SELECT k, n::DOUBLE AS n, round(objective, 6) AS objective, n >= total / 5 * 0.5 AND row_number() OVER (ORDER BY n, k) > 1 AS good FROM w, t""")
def proclus_evaluation(spark, sf):
    """Objective, points of each medoid, and which medoids are good: enough points, and not the fewest."""
    objective, n, _, good = proclus.evaluate(_points(spark, sf), _medoids(spark, sf), DIMS, 0.5)
    return spark.createDataFrame([(k, float(n[k]), round(objective, 6), bool(good[k])) for k in MEDOIDS], "k long, n double, objective double, good boolean")


@query(f"WITH {_SEGMENTAL} SELECT vec_id, own.k::INTEGER AS cluster FROM own JOIN delta ON own.k = delta.k WHERE d < delta / 3")
def proclus_outliers(spark, sf):
    """Points within a radius of their medoid; all others are outliers."""
    m = _medoids(spark, sf)
    found = [proclus.Medoid(k, m[k], DIMS[k], float(d) / 3, m[k], 0) for k, d in enumerate(proclus.radii(m))]
    return proclus.members(_points(spark, sf), found).select("vec_id", "cluster")


@query(f"WITH {_BASE}, a AS (SELECT vec_id, k, sum(abs(x - c)) AS d FROM e JOIN m ON e.i = m.i GROUP BY 1, 2), f AS (SELECT vec_id, min(d) AS d FROM a GROUP BY 1) SELECT round(max(d), 6) AS away, arg_max(vec_id, d) AS vec_id FROM f")
def farthest_point(spark, sf):
    """The point with the greatest distance to the nearest of those chosen."""
    points = _points(spark, sf)
    away, point = proclus.farthest(points, _medoids(spark, sf))
    at = points.where(F.col("point") == F.array(*[F.lit(float(x)) for x in point]))
    return at.select(F.lit(round(float(away), 6)).alias("away"), "vec_id")


@query(f"WITH {proclus_sql('SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice] AS v FROM part', 3, 2, 4, 0.1, 0.5, 5)} SELECT k::INTEGER AS cluster, count(*) AS n FROM kept GROUP BY 1")
def proclus_command(spark, sf):
    """The command line on a written table, and the points of each cluster that it writes."""
    given, made = Scratch(spark).path, Scratch(spark).path
    table(spark, sf, "part").select("p_size", "p_retailprice").write.parquet(given)
    proclus_command_line.main(["--input", given, "--output", made, "--k", "3", "--l", "2", "--maxIterations", "4", "--splitSize", "0.5", "--seed", "5"])
    return common.folded(spark.read.parquet(f"{made}/clustered-points")).withColumnRenamed("count", "n")


@query(f"WITH {_BASE}, t AS (SELECT k, sum(abs(c)) FILTER (i IN (k, k + 1, k + 7)) AS total FROM m GROUP BY 1) SELECT m.k, i, round(CASE WHEN i IN (m.k, m.k + 1, m.k + 7) THEN abs(c) / total * delta ELSE 0 END, 6) AS radius FROM m JOIN t ON t.k = m.k JOIN delta ON delta.k = m.k")
def proclus_plot_radius(spark, sf):
    m = _medoids(spark, sf)
    found = [proclus.Medoid(k, m[k], DIMS[k], float(d), m[k], 0) for k, d in enumerate(proclus.radii(m))]
    return rounded(_matrix(spark, np.array([proclus.plot_radius(x) for x in found]), "radius"), 6)


_ROUND = """d{n} AS (SELECT e.vec_id, c.k, sum((x - c) * (x - c)) AS d FROM e JOIN c{n} c ON e.i = c.i GROUP BY 1, 2),
o{n} AS (SELECT vec_id, arg_min(k, (d, k)) AS k FROM d{n} GROUP BY 1),
c{next} AS (SELECT k, i, avg(x) AS c FROM o{n} JOIN e USING (vec_id) GROUP BY 1, 2)"""


@query(f"""WITH {_BASE}, c0 AS (SELECT * FROM m), {", ".join(_ROUND.format(n=n, next=n + 1) for n in range(3))}, {_ROUND.format(n=3, next=4)}
SELECT c3.k, c3.i, round(c, 6) AS x, (SELECT count(*) FROM o3 WHERE o3.k = c3.k) AS n FROM c3""")
def kmeans_rounds(spark, sf):
    """Three rounds from given centers, and the points of each."""
    clusters, _ = kmeans.kmeans(_points(spark, sf), _medoids(spark, sf), 0.0, 3, should_cluster=False)
    made = [(c.id, i, round(float(x), 6), c.n) for c in clusters for i, x in enumerate(c.center)]
    return spark.createDataFrame(made, "k long, i long, x double, n long")


@query(f"WITH {_BASE}, c0 AS (SELECT * FROM m), {_ROUND.format(n=0, next=1)} SELECT k::INTEGER AS cluster, count(*) AS count FROM o0 GROUP BY 1")
def points_per_cluster(spark, sf):
    return common.folded(common.assign(_points(spark, sf), common.nearest(_medoids(spark, sf))))


@query(f"WITH {_BASE} SELECT a.k AS a, b.k AS b, round(sum((a.c - b.c) * (a.c - b.c)), 6) AS squared FROM m a JOIN m b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2")
def cluster_distances(spark, sf):
    """Accessors of clusters, and the squared distance of their centers."""
    clusters = common.cluster_frame(spark, [common.Cluster(k, c, c * 0, 1) for k, c in enumerate(_medoids(spark, sf))]).select(F.col("cluster").cast("long").alias("cluster"), "center")
    a, b = (clusters.select(F.col("cluster").alias(n), F.col("center").alias("c" + n)) for n in "ab")
    return rounded(a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", vectors.squared_euclidean(F.col("ca"), F.col("cb")).alias("squared")), 6)


@query(f"""WITH RECURSIVE {canopy_sql("SELECT s_suppkey AS id, [s_acctbal] AS v FROM supplier", 1500, 800)},
own AS (SELECT id, arg_min(k, (list_distance(p.v, c.v), k)) AS k FROM p, canopies c GROUP BY 1),
n AS (SELECT k, count(*) AS n, sqrt(var_pop(v[1])) AS radius FROM own JOIN p USING (id) GROUP BY 1)
SELECT c.k::INTEGER AS cluster, round(c.v[1], 4) AS center, round(coalesce(radius, 0), 4) AS radius, coalesce(n, 0)::BIGINT AS n FROM canopies c LEFT JOIN n ON n.k = c.k""")
def canopy_centers(spark, sf):
    """Canopies on a line, with the number and deviation of the points nearest to each."""
    points = table(spark, sf, "supplier").select(F.array("s_acctbal").alias("point"))
    made, _ = canopy.canopy_frames(points, 1500, 800, should_cluster=False)
    return rounded(made.select("cluster", F.get("center", F.lit(0)).alias("center"), F.get("radius", F.lit(0)).alias("radius"), "n"))


_SPARSE = """e AS (SELECT id, i, x FROM (SELECT row_number() OVER () AS id, [l_discount, l_tax, l_quantity / 25 - 1] AS v FROM lineitem), unnest(generate_series(0, 2)) AS s(i), unnest([v[i + 1]]) AS t(x)),
c0(k, i, c) AS (VALUES (0, 0, 0.0131::DOUBLE), (0, 1, 0.0217), (0, 2, -0.731), (1, 0, 0.0731), (1, 1, 0.0071), (1, 2, 0.0013), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.913))"""
SPARSE_SEEDS = np.array([[0.0131, 0.0217, -0.731], [0.0731, 0.0071, 0.0013], [0.0, 0.0, 0.913]])

_SPARSE_ROUND = _ROUND.replace("e.vec_id", "e.id").replace("vec_id", "id")


@query(f"""WITH {_SPARSE}, {", ".join(_SPARSE_ROUND.format(n=n, next=n + 1) for n in range(3))}, {_SPARSE_ROUND.format(n=3, next=4)}
SELECT c3.k::BIGINT AS k, c3.i::BIGINT AS i, round(c, 6) AS x, (SELECT count(*) FROM o3 WHERE o3.k = c3.k) AS n FROM c3""")
def kmeans_sparse(spark, sf):
    """Three rounds over sparse vectors, of which many components are zero."""
    lines = table(spark, sf, "lineitem").select("l_discount", "l_tax", (F.col("l_quantity") / 25 - 1).alias("l_quantity"))
    sparse = rows.vectorize(lines, ["l_discount", "l_tax", "l_quantity"], "sparse")
    clusters, _ = kmeans.kmeans(sparse, SPARSE_SEEDS, 0.0, 3, should_cluster=False)
    made = [(c.id, i, round(float(x), 6), c.n) for c in clusters for i, x in enumerate(c.center)]
    return spark.createDataFrame(made, "k long, i long, x double, n long")


_MODELS = f"""WITH {_MEANS},
z AS (SELECT vec_id, m.label AS k, ln((m.label + 1) / 55.0) - 0.5 * sum(((x - c) / (0.3 + 0.02 * m.label)) ** 2) - 64 * ln(0.3 + 0.02 * m.label) AS z FROM e JOIN m ON e.i = m.i GROUP BY 1, 2),
w AS (SELECT vec_id, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS w FROM z),
s AS (SELECT vec_id, k, w / sum(w) OVER (PARTITION BY vec_id) AS probability FROM w)"""


def _models(spark, sf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    means = np.array([r["center"] for r in sorted(common.model_rows(_label_means(_points(spark, sf))))])
    k = np.arange(len(means))
    return (k + 1) / 55, means, np.repeat((0.3 + 0.02 * k)[:, None], means.shape[1], 1)


@query(f"{_MODELS} SELECT vec_id, arg_max(k, probability)::INTEGER AS cluster FROM s GROUP BY 1")
def dirichlet_most_likely(spark, sf):
    return dirichlet.assign_models(_points(spark, sf), *_models(spark, sf)).select("vec_id", "cluster")


@query(f"{_MODELS} SELECT vec_id, k::INTEGER AS cluster, round(probability, 5) AS probability FROM s WHERE probability >= 0.05")
def dirichlet_soft(spark, sf):
    """Every model whose share of a point is large enough."""
    return rounded(dirichlet.assign_models(_points(spark, sf), *_models(spark, sf), False, 0.05).select("vec_id", "cluster", "probability"), 5)


# Time series with nulls and text


@query("""SELECT date_trunc('week', ts)::TIMESTAMP AS ts, round(avg(v), 4) AS value, (sum(u) // count(u))::BIGINT AS user_id, arg_min(t, (ts, t)) FILTER (t IS NOT NULL) AS event_type
  FROM (SELECT ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 2 = 0 THEN user_id END AS u, nullif(event_type, 'click') AS t FROM events) GROUP BY 1""")
def ts_agg_nulls_and_text(spark, sf):
    """Nulls don't count; text keeps the value of the earliest row that has one."""
    e = table(spark, sf, "events").select("ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"))
    return rounded(plain_time(timeseries.aggregate(e, "ts", "week", "average"), "ts"))


@query("SELECT date, round(average, 3) AS average, round(variance, 1) AS variance FROM (" + _STATIONARITY + ")")
def stationarity_of_text_dates(spark, sf):
    """Dates as text in a declared format."""
    orders = table(spark, sf, "orders").select("o_totalprice", F.date_format("o_orderdate", "yyyy/MM/dd").alias("o_orderdate", metadata={"kind": "date-time", "format": "yyyy/MM/dd"}))
    out = timeseries.stationarity(orders, "o_totalprice", "o_orderdate", "week")
    return plain_time(out.select("date", F.round("average", 3).alias("average"), F.round("variance", 1).alias("variance")), "date")


# Brushes and plots


@query("SELECT p_size / max(p_size) OVER ()::DOUBLE AS p_size, p_retailprice / max(p_retailprice) OVER () AS p_retailprice FROM part")
def axis_scale_zero_max(spark, sf):
    return brush.scaled(table(spark, sf, "part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], "zero_max")


_ALL = "(SELECT least(min(s_acctbal), min(s_nationkey), 0) AS lo, greatest(max(s_acctbal), max(s_nationkey)) AS hi FROM supplier)"


@query(f"SELECT round((s_acctbal - lo) / (hi - lo), 9) AS s_acctbal, round((s_nationkey - lo) / (hi - lo), 9) AS s_nationkey FROM supplier, {_ALL}")
def axis_scale_global(spark, sf):
    """All axes from the least of all values and 0 to the greatest of all."""
    return rounded(brush.scaled(table(spark, sf, "supplier").select("s_acctbal", "s_nationkey"), ["s_acctbal", "s_nationkey"], "global"), 9)


@query(f"SELECT s_suppkey AS row_id, 1.0::DOUBLE AS weight FROM supplier, {_ALL} WHERE (s_acctbal - lo) / (hi - lo) - (s_nationkey - lo) / (hi - lo) BETWEEN 0.2 AND 0.6")
def correlation_brush(spark, sf):
    return brush.correlation_brush(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "row_id"), "s_acctbal", "s_nationkey", 0.2, 0.6, "global")


@query("SELECT s_suppkey, CASE s_nationkey WHEN 3 THEN 'three' WHEN 4 THEN 'four' ELSE s_nationkey::VARCHAR END AS label FROM supplier")
def value_labels(spark, sf):
    return brush.value_labels(table(spark, sf, "supplier"), "s_nationkey", {3: "three", 4: "four"}).select("s_suppkey", "label")


def _widths(base: str, whole: str) -> None:
    @query(f"""WITH v AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
n AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS count, sum(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS brushed FROM events, v GROUP BY 1),
k AS (SELECT range::INTEGER AS bin, coalesce(n.count, 0)::BIGINT AS count, coalesce(brushed, 0)::DOUBLE AS brushed FROM range(10) LEFT JOIN n ON n.bin = range)
SELECT bin, count, brushed, round(count / w, 6) AS width, round(brushed / w, 6) AS brushed_width FROM k, (SELECT {whole}::DOUBLE AS w FROM k)""", f"axis_histogram_{base}")
    def _(spark, sf):
        events = table(spark, sf, "events").withColumnRenamed("event_id", "row_id")
        weights = events.where("row_id % 4 = 0").select("row_id", F.lit(0.5).alias("weight"))
        return rounded(brush.histogram_widths(events, "value", weights, base).drop("low", "high"), 6)


_widths("total", "sum(count)")
_widths("fullest", "max(count)")
_widths("fullest_brushed", "max(brushed)")


@query("SELECT label::INTEGER AS cluster, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE label <> 9")
def cluster_plot_3d(spark, sf):
    """Triples of columns; outliers aren't shown."""
    name = F.when(F.col("label") == 9, "OUTLIER 9").otherwise(F.col("label").cast("string"))
    shown = plots.cluster_plots(_points(spark, sf).select(name.alias("cluster"), "point"), ["a", "b", "c"], 3)["a", "b", "c"]
    return shown.withColumn("cluster", F.col("cluster").cast("int"))


@query(f"WITH {_BASE} SELECT a.k::INTEGER AS cluster, a.c AS x, b.c AS y, abs(a.c) AS rx, abs(b.c) AS ry FROM m a JOIN m b ON a.k = b.k AND a.i = 0 AND b.i = 1")
def cluster_ellipses(spark, sf):
    """Centers and half axes of clusters in the plane of two columns."""
    clusters = common.cluster_frame(spark, [common.Cluster(k, c, np.abs(c), 1) for k, c in enumerate(_medoids(spark, sf))])
    return plots.cluster_ellipses(clusters, ["a", "b"])["a", "b"]


@query("SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice, l_discount FROM lineitem")
def view_table_of_all(spark, sf):
    """A view of a sample with share 1 is one of all rows."""
    return plots.view_table("scatter-3d", table(spark, sf, "lineitem"), sample=1.0, seed=1, columns=["l_quantity", "l_extendedprice", "l_discount"])


@query("SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS value FROM embeddings")
def to_point(spark, sf):
    """Columns as a point."""
    e = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(1)).alias("b"))
    return rounded(e.select("vec_id", F.get(vectors.to_point([F.col("vec_id"), F.col("b")]), F.lit(1)).alias("value")), 6)
