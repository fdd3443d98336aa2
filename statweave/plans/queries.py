"""One query per operator over the driver's tables, and DuckDB SQL for those that SQL expresses.

Doubles that depend on the order of additions are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import brush, plots, rows, stats, timeseries
from ..operators.clustering import canopy, common, dirichlet, kmeans, proclus, validation
from ..sources.storage import Stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# Rows


@query("SELECT count(*) AS count FROM lineitem")
def count_lines(spark, sf):
    return rows.count_lines(table(spark, sf, "lineitem"))


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def filter_table(spark, sf):
    return rows.filter_table(table(spark, sf, "orders"), "o_totalprice > 100000 AND o_orderstatus = 'O'")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity % 7 = 3")
def filter_table_function(spark, sf):
    return rows.filter_table(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), lambda r: bool(r["l_quantity"] % 7 == 3))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_table(spark, sf):
    return rows.map_table(table(spark, sf, "lineitem"), {"revenue": F.col("l_extendedprice") * (1 - F.col("l_discount"))}).select("l_orderkey", "l_linenumber", "revenue")


@query("SELECT s_suppkey::DOUBLE AS x0, s_nationkey::DOUBLE AS x1, s_acctbal AS x2 FROM supplier")
def vectorize(spark, sf):
    point = rows.vectorize(table(spark, sf, "supplier"), ["s_suppkey", "s_nationkey", "s_acctbal"])
    return point.select(*[F.get("point", F.lit(i)).alias(f"x{i}") for i in range(3)])


@query("""SELECT o_orderkey, epoch_ms(o_orderdate)::DOUBLE AS ms FROM orders""")
def vectorize_datetime(spark, sf):
    return rows.vectorize(table(spark, sf, "orders"), ["o_orderdate"], keep=["o_orderkey"]).select("o_orderkey", F.get("point", F.lit(0)).alias("ms"))


@query("""SELECT (p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) FROM part) - (SELECT min(p_size) FROM part))::DOUBLE AS p_size,
  (p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)) AS p_retailprice FROM part""")
def normalization(spark, sf):
    part, names = table(spark, sf, "part"), ["p_size", "p_retailprice"]
    b = {r["column"]: r for r in stats.axis_bounds(part, names).collect()}
    return rows.normalize(part, names, [b[c]["min"] for c in names], [b[c]["max"] for c in names])


_DRAWN = "((('0x' || substr(md5('1:' || event_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


@query(f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (ORDER BY {_DRAWN}) AS place FROM events) WHERE place <= (SELECT round(count(*) * 0.1) FROM events)")
def sample_exact(spark, sf):
    return rows.sample_exact(table(spark, sf, "events"), 0.1, seed=1, key=["event_id"])


@query("SELECT round(count(*) * 0.1)::BIGINT AS n FROM events")
def sample_exact_size(spark, sf):
    return rows.sample_exact(table(spark, sf, "events"), 0.1, seed=1).agg(F.count("*").alias("n"))


@query(f"SELECT * FROM events WHERE {_DRAWN} < 0.1")
def sample_bernoulli(spark, sf):
    return rows.sample_bernoulli(table(spark, sf, "events"), 0.1, 1, ["event_id"])


# Statistics


@query("SELECT avg(l_quantity) AS avg, min(l_quantity) AS min, max(l_quantity) AS max, count(l_quantity)::DOUBLE AS count FROM lineitem")
def centrality(spark, sf):
    return stats.centrality(table(spark, sf, "lineitem"), "l_quantity")


@query("""SELECT round(avg(epoch_ms(o_orderdate)::DOUBLE), 0) AS avg, min(epoch_ms(o_orderdate))::DOUBLE AS min, max(epoch_ms(o_orderdate))::DOUBLE AS max,
  count(o_orderdate)::DOUBLE AS count FROM orders""")
def centrality_datetime(spark, sf):
    return rounded(stats.centrality(table(spark, sf, "orders"), "o_orderdate"), 0)


@query("SELECT round(avg((40000 - l_extendedprice) * (40000 - l_extendedprice)), 2) AS var, round(sqrt(avg((40000 - l_extendedprice) * (40000 - l_extendedprice))), 4) AS stdev FROM lineitem")
def dispersion(spark, sf):
    return stats.dispersion(table(spark, sf, "lineitem"), "l_extendedprice", 40000.0).select(F.round("var", 2).alias("var"), F.round("stdev", 4).alias("stdev"))


@query("SELECT l_quantity::DOUBLE AS value, count(*)::DOUBLE AS count FROM lineitem GROUP BY 1")
def frequency_distribution(spark, sf):
    return stats.frequency_distribution(table(spark, sf, "lineitem"), "l_quantity")


def _stats_sql(name: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", round(avg({c}::DOUBLE), 4) AS average, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(var_pop({c}::DOUBLE), 2) AS variance, round(stddev_pop({c}::DOUBLE), 4) AS standard_deviation FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=name) for c in columns)


def _table_stats(spark, sf, name):
    return stats.table_stats(table(spark, sf, name)).select("column", F.round("average", 4).alias("average"), "min", "max", F.round("variance", 2).alias("variance"), F.round("standard_deviation", 4).alias("standard_deviation"))


@query(_stats_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def table_stats(spark, sf):
    return _table_stats(spark, sf, "lineitem")


@query(_stats_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def table_stats_part(spark, sf):
    return _table_stats(spark, sf, "part")


@query("SELECT 'o_totalprice' AS \"column\", min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def axis_bounds(spark, sf):
    return stats.axis_bounds(table(spark, sf, "orders"), ["o_totalprice"])


@query("SELECT round(var_samp(c_acctbal), 2) AS variance FROM customer")
def sample_variance(spark, sf):
    return rounded(stats.sample_variance(table(spark, sf, "customer"), "c_acctbal"), 2)


# Time series


@query("SELECT * FROM events WHERE ts IS NOT NULL")
def ts_sort(spark, sf):
    return timeseries.sort(table(spark, sf, "events"), "ts")


@query("SELECT count(*) AS rows, 0::BIGINT AS late, min(ts)::TIMESTAMP AS first, max(ts)::TIMESTAMP AS last FROM events")
def ts_sort_order(spark, sf):
    """How many rows come before an earlier one: none, inside partitions and from one to the next."""
    placed = timeseries.sort(table(spark, sf, "events"), "ts").select("ts", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    held = Stored(placed)
    before = F.lag("ts").over(Window.partitionBy("part").orderBy("id"))
    inside = held.df.select("ts", (before > F.col("ts")).alias("late"))
    parts = held.df.groupBy("part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).sort("part").collect()  # a row per partition
    across = sum(a["hi"] > b["lo"] for a, b in zip(parts, parts[1:], strict=False))
    late = F.count_if("late") + F.lit(across).cast("long")
    return plain_time(inside.agg(F.count("*").alias("rows"), late.alias("late"), F.min("ts").alias("first"), F.max("ts").alias("last")), "first", "last")


def _aggregate(period: str, function: str) -> None:
    sql = {"average": "avg", "max": "max", "min": "min", "sum": "sum"}[function]
    name = f"ts_agg_{period}_{function}"

    @query(f"SELECT date_trunc('{period}', ts)::TIMESTAMP AS ts, round({sql}(value), 4) AS value FROM events GROUP BY 1", name)
    def _(spark, sf):
        return rounded(plain_time(timeseries.aggregate(table(spark, sf, "events").select("ts", "value"), "ts", period, function), "ts"))

    @query(
        f"SELECT date_trunc('{period}', o_orderdate)::TIMESTAMP AS o_orderdate, {'(sum(o_custkey) // count(o_custkey))::BIGINT' if function == 'average' else f'{sql}(o_custkey)::BIGINT'} AS o_custkey FROM orders GROUP BY 1",
        f"{name}_long",
    )
    def _(spark, sf):
        return plain_time(timeseries.aggregate(table(spark, sf, "orders").select("o_orderdate", "o_custkey"), "o_orderdate", period, function), "o_orderdate")


for _p in ("day", "week", "month", "year"):
    for _f in timeseries.FUNCTIONS:
        _aggregate(_p, _f)


@query("SELECT date_trunc('week', ts + INTERVAL 1 DAY)::TIMESTAMP AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1")
def ts_agg_week_from_sunday(spark, sf):
    return rounded(plain_time(timeseries.aggregate(table(spark, sf, "events").select("ts", "value"), "ts", "week", "sum", week_start="sunday"), "ts"))


@query("SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS l_shipdate, sum(l_linenumber::BIGINT * 300000000)::BIGINT AS big FROM lineitem GROUP BY 1")
def ts_agg_wide_sums(spark, sf):
    """Sums of ints beyond an int."""
    lines = table(spark, sf, "lineitem").select("l_shipdate", (F.col("l_linenumber") * 300_000_000).cast("int").alias("big"))
    return plain_time(timeseries.aggregate(lines, "l_shipdate", "year", "sum"), "l_shipdate")


_STATIONARITY = "SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS date, avg(o_totalprice) AS average, var_pop(o_totalprice) AS variance, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum FROM orders GROUP BY 1"


@query(f"SELECT date, round(average, 3) AS average, round(variance, 1) AS variance, minimum, maximum FROM ({_STATIONARITY})")
def stationarity(spark, sf):
    out = timeseries.stationarity(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "week")
    return plain_time(out.withColumns({"average": F.round("average", 3), "variance": F.round("variance", 1)}), "date")


@query(f"SELECT round(var_samp(average) / 1e6, 4) AS avg_var, round(var_samp(variance) / 1e15, 4) AS var_var FROM ({_STATIONARITY})")
def stationarity_summary(spark, sf):
    out = timeseries.stationarity_summary(timeseries.stationarity(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "week"))
    return out.select(F.round(F.col("avg_var") / 1e6, 4).alias("avg_var"), F.round(F.col("var_var") / 1e15, 4).alias("var_var"))


# Clustering


def _points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("point"))


def _label_means(points):
    each = points.select("label", F.posexplode("point").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("center"))


_MEANS = """
p AS (SELECT vec_id, label, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings),
e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM p),
m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2)"""


@query(f"""WITH {_MEANS},
d AS (SELECT e.label, vec_id, sum(abs(x - c)) AS d FROM e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY 1, 2),
s AS (SELECT label, sqrt(avg(d * d)) AS s FROM d GROUP BY 1),
b AS (SELECT a.label AS i, z.label AS j, sqrt(sum((a.c - z.c) * (a.c - z.c))) AS m FROM m a JOIN m z ON a.i = z.i AND a.label <> z.label GROUP BY 1, 2),
w AS (SELECT b.i, max((x.s + y.s) / m) AS worst FROM b JOIN s x ON b.i = x.label JOIN s y ON b.j = y.label GROUP BY 1)
SELECT round(avg(worst), 6) AS "index" FROM w""")
def davies_bouldin(spark, sf):
    points = _points(spark, sf)
    clustered = points.select(F.col("label").alias("cluster"), "point")
    return rounded(validation.davies_bouldin(clustered, _label_means(points).withColumnRenamed("label", "cluster")), 6)


@query(f"""WITH {_MEANS},
d AS (SELECT vec_id, m.label, sum((x - c) * (x - c)) AS d FROM e JOIN m ON e.i = m.i GROUP BY 1, 2)
SELECT vec_id, arg_min(label, d) AS cluster FROM d GROUP BY 1""")
def kmeans_assign_step(spark, sf):
    points = _points(spark, sf)
    means = sorted(common.model_rows(_label_means(points)))
    labels, pick = np.array([r[0] for r in means]), common.nearest(np.array([r[1] for r in means]))
    return common.assign(points, lambda x: labels[pick(x)]).select("vec_id", "cluster")


@query("""WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], v), 6) AS euclidean,
  round(list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda z: abs(z[1] - z[2]))), 6) AS manhattan,
  round(abs(embedding[1]::DOUBLE - v[1]) + abs(embedding[4]::DOUBLE - v[4]), 6) AS segmental FROM embeddings, a""")
def distances(spark, sf):
    points = _points(spark, sf)
    first = points.where("vec_id = 0").select(F.col("point").alias("v")).limit(1)
    both = points.join(F.broadcast(first))
    p, v = F.col("point"), F.col("v")
    dims = F.array(F.lit(0), F.lit(3))
    return rounded(both.select("vec_id", vectors.euclidean(p, v).alias("euclidean"), vectors.manhattan(p, v).alias("manhattan"), vectors.segmental(p, dims, v).alias("segmental")), 6)


def canopy_sql(points: str, t1: float, t2: float) -> str:
    """CTEs of the whole rule on rows (id, v double[]): points in order ``p``, founders one after another ``f``, centers ``canopies`` (k, v)."""
    return f"""
pts AS MATERIALIZED ({points}),
p AS MATERIALIZED (SELECT id, v, dense_rank() OVER (ORDER BY md5(array_to_string(list_transform(v, lambda x: floor(x * 1048576)::BIGINT::VARCHAR), ',')), v) AS place FROM pts),
free(xs) AS (SELECT list(DISTINCT {{'place': place, 'v': v}} ORDER BY {{'place': place, 'v': v}}) FROM p
  UNION ALL SELECT list_filter(xs, lambda x: list_distance(x.v, xs[1].v) >= {t2}) FROM free WHERE len(xs) > 0),
f AS MATERIALIZED (SELECT xs[1].place AS place, xs[1].v AS v, row_number() OVER (ORDER BY xs[1].place) - 1 AS k FROM free WHERE len(xs) > 0),
member AS (SELECT f.k, p.v FROM f JOIN p ON p.place >= f.place AND list_distance(p.v, f.v) < {t1}),
part AS (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM member),
canopies AS MATERIALIZED (SELECT k, list(x ORDER BY i) AS v FROM (SELECT k, i, avg(x) AS x FROM part GROUP BY 1, 2) GROUP BY 1)"""


_VECTORS = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"""WITH RECURSIVE {canopy_sql(_VECTORS, 1.2, 1.0)},
own AS (SELECT id, arg_min(k, (list_distance(p.v, c.v), k)) AS k FROM p, canopies c GROUP BY 1),
n AS (SELECT k, count(*) AS n FROM own GROUP BY 1)
SELECT c.k::INTEGER AS cluster, round(c.v[1], 6) AS first, round(list_sum(c.v), 6) AS total, coalesce(n, 0)::BIGINT AS n FROM canopies c LEFT JOIN n ON n.k = c.k""")
def canopy_clusters(spark, sf):
    """The whole run: founders in the order of the points' hashes, means of members, and the points nearest to each."""
    made, _ = canopy.canopy_frames(_points(spark, sf).select("point"), 1.2, 1.0, should_cluster=False)
    total = F.aggregate("center", F.lit(0.0), lambda s, x: s + x)
    return rounded(made.select("cluster", F.get("center", F.lit(0)).alias("first"), total.alias("total"), "n"), 6)


def _lloyd_sql(rounds: int, delta: float) -> str:
    """CTEs of k-means from ``canopies`` over ``p``: c{rounds} after at most so many rounds, each only as long as a center has moved farther than delta."""
    made = ["c0 AS (SELECT k, v, false AS done FROM canopies)"]
    for n in range(rounds):
        made.append(f"""o{n} AS MATERIALIZED (SELECT id, arg_min(k, (list_distance(p.v, c.v), k)) AS k FROM p, c{n} c WHERE NOT (SELECT bool_and(done) FROM c{n}) GROUP BY 1),
m{n} AS (SELECT k, list(x ORDER BY i) AS v FROM (SELECT k, i, avg(x) AS x FROM (SELECT o.k, generate_subscripts(p.v, 1) AS i, unnest(p.v) AS x FROM o{n} o JOIN p ON p.id = o.id) GROUP BY 1, 2) GROUP BY 1),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v, max(list_distance(coalesce(m.v, c.v), c.v)) OVER () <= {delta} AS done FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k)""")
    return ",\n".join(made)


@query(f"""WITH RECURSIVE {canopy_sql(_VECTORS, 1.15, 1.1)}, {_lloyd_sql(10, 0.001)}
SELECT vec_id, label, arg_min(k, (list_distance(embedding::DOUBLE[], c.v), k))::INTEGER AS cluster FROM embeddings, c10 c GROUP BY 1, 2""")
def kmeans_clusters(spark, sf):
    points = _points(spark, sf)
    # All canopies are seeds. Most distances are near 1.41; wider canopies have means so alike that they fall into one.
    seeds, _ = canopy.canopy(points, 1.15, 1.1, should_cluster=False)
    _, clustered = kmeans.kmeans(points, seeds, 0.001, 10)
    return clustered.select("vec_id", "label", "cluster")


def _uniform_sql(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _normal_sql(text: str) -> str:
    one, two = (_uniform_sql(f"{text} || ':{x}'") for x in "ab")
    return f"(sqrt(-2 * ln({one})) * cos(2 * pi() * {two}))"


def dirichlet_sql(points: str, models: int, iterations: int, alpha0: float, seed: int) -> str:
    """CTEs of a whole run on rows (id, v double[]): ``shares`` (id, k, p) of the models after the iterations. Draws come from md5, as the operator's."""
    chance = lambda it: _normal_sql(f"'{seed}:{it}:' || k || ':' || (i - 1)")
    posterior = """SELECT id, k, w / sum(w) OVER (PARTITION BY id) AS p FROM (
  SELECT id, k, exp(z - max(z) OVER (PARTITION BY id)) AS w FROM (
    SELECT e.id, m.k, ln(any_value(share)) - 0.5 * sum(((x - m.m) / m.s) ** 2) - sum(ln(m.s)) AS z FROM e JOIN m{n} m ON e.i = m.i JOIN mix{n} ON mix{n}.k = m.k GROUP BY 1, 2))"""
    made = [f"""pts AS MATERIALIZED ({points}),
keyed AS MATERIALIZED (SELECT id, md5(array_to_string(list_transform(v, lambda x: floor(x * 1048576)::BIGINT::VARCHAR), ',')) AS key FROM pts),
e AS MATERIALIZED (SELECT id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM pts),
base AS MATERIALIZED (SELECT i, avg(x) AS center, sqrt(greatest(1e-12, avg(x * x) - avg(x) ** 2)) AS spread FROM e GROUP BY 1),
models AS (SELECT unnest(range({models})) AS k),
m0 AS MATERIALIZED (SELECT k, i, center + spread * {chance(0)} AS m, spread AS s FROM models, base),
mix0 AS (SELECT k, 1.0::DOUBLE / {models} AS share FROM models)"""]
    for n in range(1, iterations + 1):
        gamma = f"'{seed}:{n}:mix:' || k || ':'"
        made.append(f"""p{n} AS ({posterior.format(n=n - 1)}),
z{n} AS MATERIALIZED (SELECT id, least(count(*) FILTER (total < u), {models - 1}) AS k FROM (
  SELECT p.id, {_uniform_sql(f"'{seed}:{n}:' || key")} AS u, sum(p) OVER (PARTITION BY p.id ORDER BY k) AS total FROM p{n} p JOIN keyed ON keyed.id = p.id) GROUP BY 1),
c{n} AS MATERIALIZED (SELECT models.k, count(z.k)::DOUBLE AS n FROM models LEFT JOIN z{n} z ON z.k = models.k GROUP BY 1),
s{n} AS MATERIALIZED (SELECT z.k, i, avg(x) AS mean, avg(x * x) AS square FROM z{n} z JOIN e ON e.id = z.id GROUP BY 1, 2),
d{n} AS (SELECT models.k, base.i, center, spread, mean, sqrt(greatest((0.01 * spread) ** 2 + 1e-12, square - mean ** 2)) AS dev, n FROM models CROSS JOIN base
  LEFT JOIN s{n} s ON s.k = models.k AND s.i = base.i JOIN c{n} c ON c.k = models.k),
m{n} AS MATERIALIZED (SELECT k, i, CASE WHEN n > 0 THEN mean + dev / sqrt(n) * {chance(n)} ELSE center + spread * {chance(n)} END AS m, CASE WHEN n > 0 THEN dev ELSE spread END AS s FROM d{n}),
g{n} AS (SELECT k, shape, d, t, {_normal_sql(gamma + " || t")} AS x, {_uniform_sql(gamma + " || t || ':u'")} AS u, 1 / sqrt(9 * d) AS c FROM (
  SELECT k, n + {alpha0}::DOUBLE / {models} AS shape, n + {alpha0}::DOUBLE / {models} + CASE WHEN n + {alpha0}::DOUBLE / {models} < 1 THEN 1 ELSE 0 END - 1 / 3.0::DOUBLE AS d, unnest(range(16)) AS t FROM c{n})),
h{n} AS (SELECT k, arg_min(d * v, t) * CASE WHEN any_value(shape) < 1 THEN {_uniform_sql(gamma + " || 'lift'")} ** (1 / any_value(shape)) ELSE 1 END AS g FROM (
  SELECT *, (1 + c * x) ** 3 AS v FROM g{n}) WHERE v > 0 AND ln(u) < 0.5 * x * x + d - d * v + d * ln(v) GROUP BY k),
mix{n} AS MATERIALIZED (SELECT k, share / sum(share) OVER () AS share FROM (SELECT k, greatest(g / sum(g) OVER (), 1e-12) AS share FROM h{n}))""")
    return ",\n".join([*made, f"shares AS ({posterior.format(n=iterations)})"])


@query(f"WITH {dirichlet_sql(_VECTORS, 10, 5, 1.0, 1)} SELECT id AS vec_id, arg_max(k, p)::INTEGER AS cluster FROM shares GROUP BY 1")
def dirichlet_clusters(spark, sf):
    """The whole run: five iterations, and each point's most likely model."""
    _, _, clustered = dirichlet.dirichlet(_points(spark, sf).select("vec_id", "point"), 10, 5, seed=1)
    return clustered.select("vec_id", "cluster")


@query(f"""WITH {dirichlet_sql("SELECT row_number() OVER () AS id, [l_discount, l_tax, l_quantity / 25 - 1] AS v FROM lineitem", 4, 3, 2.0, 7)}
SELECT k, round(m1, 5) AS x, round(m2, 5) AS y, round(s3, 5) AS deviation, n::BIGINT AS n FROM (
  SELECT m.k, max(m) FILTER (i = 1) AS m1, max(m) FILTER (i = 2) AS m2, max(s) FILTER (i = 3) AS s3, any_value(n) AS n FROM m3 m JOIN c3 ON c3.k = m.k WHERE n > 0 GROUP BY 1)""")
def dirichlet_sparse(spark, sf):
    """Models of sparse vectors after three iterations."""
    lines = table(spark, sf, "lineitem").select("l_discount", "l_tax", (F.col("l_quantity") / 25 - 1).alias("l_quantity"))
    clusters, _, _ = dirichlet.dirichlet(rows.vectorize(lines, ["l_discount", "l_tax", "l_quantity"], "sparse"), 4, 3, 2.0, should_cluster=False, seed=7)
    made = [(c.id, *(round(float(x), 5) for x in (c.center[0], c.center[1], c.radius[2])), c.n) for c in clusters]
    return spark.createDataFrame(made, "k long, x double, y double, deviation double, n long")


def proclus_sql(points: str, k: int, l: int, iterations: int, min_deviation: float, split: float, seed: int) -> str:  # noqa: E741
    """CTEs of a whole run on rows (id, v double[]): ``kept`` (id, k), the points within their medoid's radius. Sets of medoids are tables of (k, v)."""
    made = [f"""pts AS MATERIALIZED ({points}),
keyed AS MATERIALIZED (SELECT id, v, md5(array_to_string(list_transform(v, lambda x: floor(x * 1048576)::BIGINT::VARCHAR), ',')) AS key FROM pts),
e AS MATERIALIZED (SELECT id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM pts),
sampled AS MATERIALIZED (SELECT DISTINCT v, key FROM keyed WHERE {_uniform_sql(f"'{seed}:split:' || key")} < {split}),
line AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY md5('{seed + 1}:' || key), v) - 1 AS place FROM sampled),
g1 AS MATERIALIZED (SELECT 0 AS k, v FROM sampled ORDER BY md5('{seed}:' || key), v LIMIT 1)"""]
    apart = "list_sum(list_transform(list_zip(s.v, g.v), lambda z: abs(z[1] - z[2])))"
    for n in range(1, k):
        made.append(f"""g{n + 1} AS MATERIALIZED (SELECT * FROM g{n} UNION ALL (SELECT {n}, v FROM (SELECT s.v, min({apart}) AS away FROM sampled s, g{n} g GROUP BY 1) ORDER BY away DESC, v DESC LIMIT 1))""")

    def local(t: str, own: str = "") -> str:
        return f"""ms{t} AS MATERIALIZED (SELECT k, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS c FROM set{t}),
delta{t} AS MATERIALIZED (SELECT a.k, min(list_distance(a.v, b.v)) AS delta FROM set{t} a JOIN set{t} b ON a.k <> b.k GROUP BY 1),
inside{t} AS MATERIALIZED (SELECT pts.id, s.k FROM pts JOIN set{t} s ON list_distance(pts.v, s.v) <= (SELECT delta FROM delta{t} d WHERE d.k = s.k) {own}),
{dims(t)}"""

    def dims(t: str, inside: str = "inside", name: str = "dims") -> str:
        return f"""{name}mean{t} AS MATERIALIZED (SELECT m.k, m.i, avg(abs(x - c)) AS mean FROM {inside}{t} n JOIN ms{t} m ON m.k = n.k JOIN e ON e.id = n.id AND e.i = m.i GROUP BY 1, 2),
{name}order{t} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY z, i) AS r FROM (
  SELECT k, i, (mean - avg(mean) OVER (PARTITION BY k)) / stddev_samp(mean) OVER (PARTITION BY k) AS z FROM {name}mean{t})),
{name}{t} AS MATERIALIZED (SELECT k, i FROM {name}order{t} WHERE r <= 2 UNION ALL
  SELECT k, i FROM (SELECT *, row_number() OVER (ORDER BY z, k, i) AS q FROM {name}order{t} WHERE r > 2) WHERE q <= {k * (l - 2)})"""

    def owners(t: str, name: str = "dims", out: str = "own") -> str:
        return f"""{out}{t} AS MATERIALIZED (SELECT id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT e.id, m.k, sum(abs(x - c)) AS d FROM e JOIN ms{t} m ON e.i = m.i JOIN {name}{t} s ON s.k = m.k AND s.i = m.i GROUP BY 1, 2) GROUP BY 1)"""

    made.append(f"set0 AS MATERIALIZED (SELECT k, v FROM g{k})")
    for t in range(iterations):
        before = f"best{t - 1}" if t else None
        better = f"(SELECT objective FROM objective{t}) < (SELECT any_value(objective) FROM {before})" if t else "true"
        old = f" UNION ALL SELECT * FROM {before} WHERE NOT ({better})" if t else ""
        made.append(f"""{local(str(t))},
{owners(str(t))},
w{t} AS MATERIALIZED (SELECT s.k, any_value(s.v) AS v, count(DISTINCT e.id) AS n, coalesce(avg(abs(x - c)), 0) AS w FROM set{t} s LEFT JOIN own{t} o ON o.k = s.k
  LEFT JOIN e ON e.id = o.id LEFT JOIN ms{t} m ON m.k = o.k AND m.i = e.i GROUP BY 1),
objective{t} AS MATERIALIZED (SELECT sum(w / {k} * n) / sum(n) AS objective, sum(n) AS total FROM w{t}),
best{t} AS MATERIALIZED (SELECT k, v, n >= total / {k} * {min_deviation} AND row_number() OVER (ORDER BY n, k) > 1 AS good, objective FROM w{t}, objective{t} WHERE {better}{old}),
pool{t} AS (SELECT v, row_number() OVER (ORDER BY place) AS r FROM line WHERE place >= {2 * k * t} AND place < {2 * k * (t + 1)} AND v NOT IN (SELECT v FROM best{t})),
set{t + 1} AS MATERIALIZED (SELECT b.k, CASE WHEN good OR p.v IS NULL THEN b.v ELSE p.v END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY good ORDER BY k) AS r FROM best{t}) b LEFT JOIN pool{t} p ON p.r = b.r AND NOT b.good)""")
    return ",\n".join([*made, f"setf AS MATERIALIZED (SELECT k, v FROM best{iterations - 1})", local("f"), owners("f"),
        "mine AS (SELECT n.* FROM insidef n JOIN ownf o ON o.id = n.id AND o.k = n.k), minef AS MATERIALIZED (SELECT * FROM mine)", dims("f", "mine", "last"), owners("f", "last", "fin"),
        "kept AS (SELECT id, o.k FROM finf o JOIN deltaf d ON d.k = o.k WHERE o.d < d.delta)"])


@query(f"WITH {proclus_sql(_VECTORS, 5, 4, 5, 0.1, 0.2, 1)} SELECT id AS vec_id, k::INTEGER AS cluster FROM kept")
def proclus_clusters(spark, sf):
    """The whole run: sample, first medoids, iterations, refinement, and the points within their medoid's radius."""
    _, _, clustered = proclus.proclus(_points(spark, sf).select("vec_id", "point"), k=5, l=4, iterations=5, seed=1)
    return clustered.select("vec_id", "cluster")


# Plots and brushes


@query("""SELECT 'l_quantity' AS "column", min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax), quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.75), max(l_tax) FROM lineitem""")
def box_plot(spark, sf):
    return plots.box_plot(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


@query("""SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS "index", 'c_acctbal' AS series, c_acctbal AS value FROM customer
UNION ALL SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT, 'c_nationkey', c_nationkey::DOUBLE FROM customer""")
def scatter_plot(spark, sf):
    return plots.scatter_plot(table(spark, sf, "customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"])


_HISTOGRAM = """WITH b AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
n AS (SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS count FROM {t}, b GROUP BY 1),
k AS (SELECT range::INTEGER AS bin FROM range(10))
SELECT k.bin, round(lo + k.bin * ((hi - lo) / 10), 4) AS low, round(lo + (k.bin + 1) * ((hi - lo) / 10), 4) AS high, coalesce(n.count, 0)::BIGINT AS count FROM k CROSS JOIN b LEFT JOIN n ON n.bin = k.bin"""


@query(_HISTOGRAM.format(c="o_totalprice", t="orders"))
def axis_histogram(spark, sf):
    return rounded(brush.axis_histogram(table(spark, sf, "orders"), "o_totalprice"))


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", * FROM ({_HISTOGRAM.format(c=c, t='lineitem')})" for c in _LINE_COLUMNS[:2]))
def frequencies_histogram(spark, sf):
    """Several columns in two scans."""
    return rounded(plots.frequencies_histogram(table(spark, sf, "lineitem"), _LINE_COLUMNS[:2]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value, count(*)::DOUBLE AS count FROM lineitem GROUP BY 2" for c in ("l_quantity", "l_discount", "l_linenumber")))
def frequency_distributions(spark, sf):
    """Several columns in one scan."""
    return stats.frequency_distributions(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@query("SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice, l_discount FROM lineitem")
def scatter_3d(spark, sf):
    return plots.scatter_3d(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""SELECT (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity,
  (l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()) AS l_tax FROM lineitem""")
def parallel_lines(spark, sf):
    return plots.parallel_lines(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


@query("SELECT label::INTEGER AS cluster, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings")
def cluster_plot(spark, sf):
    clustered = _points(spark, sf).select(F.col("label").alias("cluster"), "point")
    return plots.cluster_plots(clustered, ["a", "b"])["a", "b"]


@query("SELECT count(*) AS count FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000")
def range_count(spark, sf):
    return brush.range_count(table(spark, sf, "orders"), "o_totalprice", 50000, 150000)


_SOFT = """(SELECT event_id AS row_id, CASE WHEN value BETWEEN {lo} AND {hi} THEN 1.0::DOUBLE WHEN value < {lo} AND value > {lo} - {r} THEN 1 - ({lo} - value) / {r}
  WHEN value > {hi} AND value < {hi} + {r} THEN 1 - (value - {hi}) / {r} ELSE 0 END AS weight FROM events)"""
_A, _B = _SOFT.format(lo="20.0::DOUBLE", hi="40.0::DOUBLE", r="4.0::DOUBLE"), _SOFT.format(lo="30.0::DOUBLE", hi="80.0::DOUBLE", r="10.0::DOUBLE")


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "value")


@query(f"SELECT row_id, round(weight, 6) AS weight FROM {_A} WHERE weight > 0")
def soft_brush(spark, sf):
    return rounded(brush.soft_brush(_events(spark, sf), "value", 20, 40), 6)


def _brush_op(how: str, sql: str) -> None:
    @query(f"SELECT row_id, round(w, 6) AS weight FROM (SELECT a.row_id, {sql} AS w FROM {_A} a JOIN {_B} b ON a.row_id = b.row_id) WHERE w > 0", f"brush_{how}")
    def _(spark, sf):
        e = _events(spark, sf)
        return rounded(brush.combine(brush.soft_brush(e, "value", 20, 40, 4.0), brush.soft_brush(e, "value", 30, 80, 10.0), how), 6)


_brush_op("add", "least(1.0, a.weight + b.weight)")
_brush_op("subtract", "greatest(0.0, a.weight - b.weight)")
_brush_op("intersect", "least(a.weight, b.weight)")


_STEPS = [("add", 30, 80, 10), ("subtract", 60, 70, 5), ("add", 5, 9, 2), ("intersect", 0, 75, 20), ("subtract", 21, 22, 1), ("add", 100, 200, 30), ("subtract", 150, 160, 8), ("intersect", 0, 170, 3), ("add", 66, 67, 1)]


def _steps_sql() -> str:
    """Weights of ten brushes side by side, and the operations one after another."""
    def weight(lo: float, hi: float, r: float) -> str:
        return f"""(CASE WHEN value BETWEEN {lo} AND {hi} THEN 1.0::DOUBLE WHEN value < {lo} AND value > {lo} - {r} THEN 1 - ({lo} - value) / {r}::DOUBLE
  WHEN value > {hi} AND value < {hi} + {r} THEN 1 - (value - {hi}) / {r}::DOUBLE ELSE 0 END)"""

    out = weight(20, 40, 4)
    for how, lo, hi, r in _STEPS:
        w = weight(lo, hi, r)
        out = {"add": f"least(1.0, {out} + {w})", "subtract": f"greatest(0.0, {out} - {w})", "intersect": f"least({out}, {w})"}[how]
    return f"SELECT row_id, round(w, 6) AS weight FROM (SELECT event_id AS row_id, {out} AS w FROM events) WHERE w > 0"


@query(_steps_sql())
def brush_many(spark, sf):
    """Ten brushes, one operation after another, in one shuffle."""
    e = _events(spark, sf)
    steps = [(how, brush.soft_brush(e, "value", lo, hi, r)) for how, lo, hi, r in _STEPS]
    return rounded(brush.combine_all(brush.soft_brush(e, "value", 20, 40, 4.0), steps), 6)


@query(f"SELECT floor(round(sum(weight), 6))::BIGINT AS count FROM {_A} a JOIN events ON event_id = row_id WHERE value >= 10 AND value < 35")
def brushed_count(spark, sf):
    e = _events(spark, sf)
    return brush.brushed_count(e, brush.soft_brush(e, "value", 20, 40), "value", 10, 35)


@query("""WITH s AS (SELECT p_partkey AS row_id, (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE AS a,
  (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part)
SELECT row_id, 1.0::DOUBLE AS weight FROM s WHERE a - b BETWEEN -0.25 AND 0.25""")
def angular_brush(spark, sf):
    return brush.angular_brush(table(spark, sf, "part").withColumnRenamed("p_partkey", "row_id"), "p_size", "p_retailprice", -0.25, 0.25)


@query("SELECT c_custkey::FLOAT AS c_custkey, c_nationkey::FLOAT AS c_nationkey, c_acctbal::FLOAT AS c_acctbal, concat_ws(chr(10), c_name, c_mktsegment) AS label FROM customer")
def records(spark, sf):
    return brush.records(table(spark, sf, "customer"))
