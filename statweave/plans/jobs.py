"""Jobs by name: configure with options, run, ask for outputs.

    job = run_job(spark, "table-stats", table=df)
    job.output()

``table`` may be a DataFrame, a Dataset or the path of a written table.  With
``output_path`` the result is written there (replacing what was) and read again.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import plots, rows, stats, timeseries
from ..operators.clustering import canopy as canopy_
from ..operators.clustering import common, validation
from ..operators.clustering import dirichlet as dirichlet_
from ..operators.clustering import kmeans as kmeans_
from ..operators.clustering import proclus as proclus_
from ..sources.tables import Dataset, Table, as_df, open_dataset


@dataclass
class Job:
    """A configured job; ``run`` fills its outputs, of which the first is the default."""

    spark: SparkSession
    name: str
    options: dict[str, Any]
    outputs: dict[str, Any] = field(default_factory=dict)

    def run(self) -> Job:
        options = dict(self.options)
        path = options.pop("output_path", None)
        table = options.pop("table", None)
        if table is not None:
            options["df"] = as_df(self.spark, table)
        self.outputs = _JOBS[self.name](**options) if self.name != "davies-bouldin-index" else _JOBS[self.name](spark=self.spark, **options)
        if path:
            for key, value in self.outputs.items():
                if isinstance(value, DataFrame):
                    at = path if len([v for v in self.outputs.values() if isinstance(v, DataFrame)]) == 1 else f"{path}/{key}"
                    value.write.mode("overwrite").parquet(at)
                    self.outputs[key] = open_dataset(self.spark, at).df
        return self

    def output(self, key: str | None = None) -> Any:
        return self.outputs[key] if key else next(iter(self.outputs.values()))

    def output_path(self, key: str | None = None) -> str | None:
        path = self.options.get("output_path")
        several = len([v for v in self.outputs.values() if isinstance(v, DataFrame)]) > 1
        return f"{path}/{key or next(iter(self.outputs))}" if path and several else path

    def visualize(self, **options: Any) -> Any:
        """The data of the plot that goes with the job's result."""
        out = self.output()
        if self.name in ("canopy", "kmeans", "proclus", "dirichlet"):
            return plots.cluster_plots(self.outputs["clustered-points"], **options)
        if self.name == "frequency-distribution":
            return out.select("value", "count")
        if self.name.startswith("time-series"):
            date = options.get("date") or self.options.get("column")
            table = self.outputs.get("table", out)
            return table.select("date", "average", "variance") if self.name == "time-series-stationarity" else table.select(date, *([options["column"]] if "column" in options else [])).orderBy(date)
        if isinstance(out, DataFrame) and len(out.columns) > 1 and self.name in ("centrality-stats", "dispersion-stats"):
            return out.unpivot([], out.columns, "label", "value")
        return out


_JOBS: dict[str, Callable[..., dict[str, Any]]] = {}


def job(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        _JOBS.update(dict.fromkeys(names, f))
        return f

    return add


def make_job(spark: SparkSession, name: str, **options: Any) -> Job:
    if name not in _JOBS:
        raise ValueError(f"no job {name!r}; one of {', '.join(_JOBS)}")
    return Job(spark, name, options)


def run_job(spark: SparkSession, name: str, **options: Any) -> Job:
    return make_job(spark, name, **options).run()


def names() -> list[str]:
    return list(_JOBS)


def job_info(name: str) -> str:
    """What a job does, and its options."""
    f = _JOBS[name]
    return f"{name}{inspect.signature(f)}\n{inspect.getdoc(f) or ''}"


def show_job_info(name: str | None = None) -> None:
    for n in [name] if name else _JOBS:
        print(job_info(n))


@job("table-count-lines")
def _count(df: DataFrame) -> dict:
    """Number of rows, those of nulls included."""
    return {"count": rows.count_lines(df)}


@job("sample-file")
def _sample_exact(df: DataFrame, percentage_to_sample: float, total_lines: int | None = None, seed: int = 0, key: list[str] | None = None) -> dict:
    """Exactly round(total * share) rows."""
    return {"table": rows.sample_exact(df, percentage_to_sample, total_lines, seed, key=key)}


@job("probabilistic-sample-table")
def _sample(df: DataFrame, sampling_probability: float, seed: int | None = None, key: list[str] | None = None) -> dict:
    """Each row with the given probability."""
    return {"table": rows.sample_bernoulli(df, sampling_probability, seed, key)}


@job("vectorize-table")
def _vectorize(df: DataFrame, column_names: list[str], vector_type: str = "dense") -> dict:
    """A vector per row of the named columns."""
    return {"vectors": rows.vectorize(df, column_names, vector_type)}


@job("filter-table")
def _filter(df: DataFrame, filter_function: Any) -> dict:
    """Rows for which a Column, SQL text or Python function is true."""
    return {"table": rows.filter_table(df, filter_function)}


@job("map-table")
def _map(df: DataFrame, map_function: Any, schema: Any = None) -> dict:
    """Rows made from rows."""
    return {"table": rows.map_table(df, map_function, schema)}


@job("normalization")
def _normalize(df: DataFrame, columns: list[str], min_values: list[float], max_values: list[float]) -> dict:
    """(x - min) / (max - min) with given bounds."""
    return {"table": rows.normalize(df, columns, min_values, max_values)}


@job("centrality-stats")
def _centrality(df: DataFrame, column: str) -> dict:
    """avg, min, max, count of a column."""
    return {"stats": stats.centrality(df, column)}


@job("dispersion-stats")
def _dispersion(df: DataFrame, column: str, average: float) -> dict:
    """Variance around a given average, and its root."""
    return {"stats": stats.dispersion(df, column, average)}


@job("frequency-distribution")
def _frequency(df: DataFrame, column: str) -> dict:
    """How often each value occurs."""
    return {"frequencies": stats.frequency_distribution(df, column)}


@job("table-stats")
def _table_stats(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Statistics of every numeric column."""
    return {"stats": stats.table_stats(df, columns)}


@job("time-series-sort")
def _sort(df: DataFrame, column: str) -> dict:
    """Rows in chronological order."""
    return {"table": timeseries.sort(df, column)}


@job("time-series-aggregate")
def _aggregate(df: DataFrame, column: str, period: str, aggregation_function: str, preserve_types: bool = True, week_start: str = "monday") -> dict:
    """A row per day, week, month or year."""
    return {"table": timeseries.aggregate(df, column, period, aggregation_function, preserve_types, week_start)}


@job("time-series-stationarity", "time-series-stationality")
def _stationarity(df: DataFrame, column: str, date_column: str, period: str, week_start: str = "monday") -> dict:
    """Average and variance by period, and how much both vary."""
    table = timeseries.stationarity(df, column, date_column, period, week_start)
    return {"table": table, "summary": timeseries.stationarity_summary(table)}


def _clusters(df: DataFrame, clusters: list | DataFrame, clustered: DataFrame | None, **more: Any) -> dict:
    out = {"clusters": clusters if isinstance(clusters, DataFrame) else common.cluster_frame(df.sparkSession, clusters)}
    if clustered is not None:
        out["clustered-points"] = clustered
        out["folded-points"] = clustered.groupBy("cluster").agg(F.count("*").alias("count"))
    return out | more


@job("canopy")
def _canopy(df: DataFrame, t1: float, t2: float, distance: str = "euclidean", should_cluster: bool = True, columns: list[str] | None = None) -> dict:
    """Canopy centers, and points by nearest center."""
    vectors.check_distance(distance)
    made, clustered = canopy_.canopy_frames(common.as_points(df, columns), t1, t2, should_cluster)
    return _clusters(df, made, clustered)


@job("kmeans")
def _kmeans(
    df: DataFrame, input_clusters: Any, convergence_delta: float = 0.0, num_iterations: int = 10, distance: str = "euclidean", should_cluster: bool = True, columns: list[str] | None = None
) -> dict:
    """k-means from the clusters of a job, of a written table or of a list."""
    vectors.check_distance(distance)
    if isinstance(input_clusters, Job):
        input_clusters = input_clusters.output("clusters")
    if isinstance(input_clusters, (str, Dataset, DataFrame)):
        input_clusters = common.read_clusters(as_df(df.sparkSession, input_clusters))
    return _clusters(df, *kmeans_.kmeans(common.as_points(df, columns), input_clusters, convergence_delta, num_iterations, should_cluster))


@job("dirichlet")
def _dirichlet(
    df: DataFrame, num_models: int, num_iterations: int, alpha_0: float = 1.0, should_emit_most_likely: bool = True, min_threshold: float = 0.0,
    should_cluster: bool = True, model_distribution: str = "gaussian", vector_model: str | None = None, distance: str = "euclidean", seed: int = 0, columns: list[str] | None = None,
) -> dict:
    """A mixture of Gaussians by Gibbs sampling, on dense or sparse vectors (``vector_model``; None: as the table has them)."""
    vectors.check_distance(distance)
    clusters, mixture, clustered = dirichlet_.dirichlet(
        common.as_points(df, columns, vector_model), num_models, num_iterations, alpha_0, should_emit_most_likely, min_threshold, should_cluster, model_distribution, seed
    )
    return _clusters(df, clusters, clustered, mixture=mixture)


@job("proclus")
def _proclus(
    df: DataFrame, k: int, l: int, num_iterations: int = 10, min_deviation: float = 0.1, split_size: float = 0.2, min_threshold: float = 0.0, seed: int = 0, columns: list[str] | None = None  # noqa: E741
) -> dict:
    """Clusters in subspaces; outliers are left out."""
    medoids, objective, clustered = proclus_.proclus(common.as_points(df, columns, "dense"), k, l, num_iterations, min_deviation, split_size, min_threshold, seed)
    found = [common.Cluster(m.id, m.vector, proclus_.plot_radius(m), m.n) for m in medoids]
    return _clusters(df, found, clustered, medoids=medoids, objective=objective)


@job("davies-bouldin-index")
def _davies_bouldin(spark: SparkSession, clustering_job: Job | None = None, clusters: Table | None = None, vectors: Table | None = None) -> dict:
    """Quality of a clustering, given as a finished job or as tables of centers and clustered points."""
    if clustering_job is not None:
        clusters, vectors = clustering_job.output("clusters"), clustering_job.output("clustered-points")
    return {"index": validation.davies_bouldin(as_df(spark, vectors), as_df(spark, clusters))}
