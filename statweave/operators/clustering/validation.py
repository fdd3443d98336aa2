"""Davies-Bouldin index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.vectors import manhattan
from .common import model_rows

#: Bytes of all centers at most: they go to all tasks.
MODEL_BYTES = 256 << 20
#: Centers that are compared with all others at a time.
ROWS = 64


def scatter(clustered: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster, scatter): root of the mean squared Manhattan distance of a cluster's points to its center."""
    d = manhattan(F.col("point"), F.col("center"))
    joined = clustered.select("cluster", "point").join(F.broadcast(centers.select("cluster", "center")), "cluster")
    return joined.groupBy("cluster").agg(F.sqrt(F.avg(d * d)).alias("scatter"))


def davies_bouldin(clustered: DataFrame, centers: DataFrame) -> DataFrame:
    """One row, ``index``: the mean over clusters of the greatest (S_i + S_j) / |c_i - c_j|.

    ``clustered``: (cluster, point); ``centers``: (cluster, center). Pairs with a
    cluster without points are passed over; such a cluster counts with 0.  Centers
    are a model (at most MAX_CLUSTERS and MODEL_BYTES, else an error); each task
    compares some of them with all.
    """
    size = centers.agg(F.sum(F.size("center") * 8)).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"centers of {size} bytes are too large a model")
    spark = centers.sparkSession
    found = model_rows(centers.select("cluster", "center").join(scatter(clustered, centers), "cluster", "left"))
    if not found:
        return spark.createDataFrame([(None,)], "index double")
    center, spread = np.array([r["center"] for r in found], float), np.array([np.nan if r["scatter"] is None else r["scatter"] for r in found])
    shared = spark.sparkContext.broadcast((center, spread))

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, spread = shared.value
        for batch in batches:
            rows, out = batch.column(0).to_numpy(), []
            for i in range(0, len(rows), ROWS):
                own = rows[i : i + ROWS]
                away = np.sqrt(np.stack([((center - c) ** 2).sum(1) for c in center[own]]))
                both = spread[own][:, None] + spread[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(away > 0, both / away, np.where(both > 0, np.inf, np.nan))
                ratio[np.arange(len(own)), own] = np.nan
                out += np.where(np.isnan(ratio).all(1), 0.0, np.fmax.reduce(ratio, 1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["worst"])

    return spark.range(len(found)).mapInArrow(worst, "worst double").agg(F.avg("worst").alias("index"))
