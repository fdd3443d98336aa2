"""Dirichlet-process clustering with Gaussian models, by Gibbs sampling.

All chance comes from md5 of the seed, the iteration and what the draw is for (a
point by its components, a model and a dimension by their numbers), so a run can be
repeated anywhere: in a task that runs twice, on other partitions, or in SQL.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, Dense
from .common import Cluster, assign, fold, kept, moments, uniforms, vector

MODELS = ("gaussian",)
#: Tries of a gamma variate; all but one in 10**20 are done by then.
TRIES = 16
#: Least share of a model in the mixture.
LEAST = 1e-12


def log_densities(x: np.ndarray | Block, means: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    """Of each point under each model with one deviation per dimension."""
    b = x if isinstance(x, Block) else Dense(x)
    out = np.empty((b.n, len(means)))
    for k, (m, s) in enumerate(zip(means, deviations, strict=True)):
        out[:, k] = -0.5 * b.scaled(m, s) - np.log(s).sum()
    return out - 0.5 * means.shape[1] * np.log(2 * np.pi)


def posterior(x: np.ndarray | Block, mixture: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    z = np.log(mixture) + log_densities(x, means, deviations)
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def uniform(*parts: object) -> float:
    """A number in (0, 1) from 13 digits of the md5 of the parts, with colons between."""
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13


def normal(*parts: object) -> float:
    return math.sqrt(-2 * math.log(uniform(*parts, "a"))) * math.cos(2 * math.pi * uniform(*parts, "b"))


def normals(seed: int, iteration: int, models: int, d: int) -> np.ndarray:
    return np.array([[normal(seed, iteration, k, j) for j in range(d)] for k in range(models)]).reshape(models, d)


def gamma(shape: float, *parts: object) -> float:
    """A Gamma(shape, 1) variate by squeezing a cubed normal one: the first of ``TRIES`` that is accepted, else the last."""
    lift = shape < 1
    d = shape + (1 if lift else 0) - 1 / 3
    c, out = 1 / math.sqrt(9 * d), d
    for t in range(TRIES):
        x = normal(*parts, t)
        v = (1 + c * x) ** 3
        if v > 0:
            out = d * v
            if math.log(uniform(*parts, t, "u")) < 0.5 * x * x + d - d * v + d * math.log(v):
                break
    return out * uniform(*parts, "lift") ** (1 / shape) if lift else out


def mixed(counts: np.ndarray, alpha0: float, seed: int, iteration: int) -> np.ndarray:
    """The mixture drawn from Dirichlet(counts + alpha0 / models), no share below LEAST."""
    k = len(counts)
    g = np.array([gamma(c + alpha0 / k, seed, iteration, "mix", i) for i, c in enumerate(counts.tolist())])
    total = g.sum()
    shares = np.maximum(g / total if total > 0 else np.full(k, 1 / k), LEAST)
    return shares / shares.sum()


def gibbs(points: DataFrame, num_models: int, iterations: int, alpha0: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Mixture, means, deviations and counts of the models after the iterations; None without points."""
    held = kept(points.select(*vector(points)))
    try:
        whole = fold(held, lambda b: moments(b, np.zeros(b.n, np.int64)), blocks=True)
        if not whole:
            return None
        s = whole[0]
        d = (len(s) - 1) // 2
        center, spread = s[1 : d + 1] / s[0], np.sqrt(np.maximum(1e-12, s[d + 1 :] / s[0] - (s[1 : d + 1] / s[0]) ** 2))
        means, deviations = center + spread * normals(seed, 0, num_models, d), np.tile(spread, (num_models, 1))
        mixture, counts = np.full(num_models, 1 / num_models), np.zeros(num_models)
        for it in range(1, iterations + 1):
            now = mixture, means, deviations

            def draw(b: Block, u: np.ndarray, now: tuple = now) -> tuple[np.ndarray, np.ndarray]:
                z = np.minimum((posterior(b, *now).cumsum(1) < u[:, None]).sum(1), num_models - 1)
                return moments(b, z)

            sums = fold(held.withColumn("u", uniforms(held, seed, it)), draw, ("u",), blocks=True)
            chance = normals(seed, it, num_models, d)
            means, deviations = center + spread * chance, np.tile(spread, (num_models, 1))  # models without points start anew
            counts = np.zeros(num_models)
            for k, s in sums.items():
                counts[k] = s[0]
                mean = s[1 : d + 1] / s[0]
                deviations[k] = np.sqrt(np.maximum((0.01 * spread) ** 2 + 1e-12, s[d + 1 :] / s[0] - mean**2))
                means[k] = mean + deviations[k] / np.sqrt(s[0]) * chance[k]
            mixture = mixed(counts, alpha0, seed, it)
    finally:
        held.unpersist()
    return mixture, means, deviations, counts


def dirichlet(
    points: DataFrame, num_models: int, iterations: int, alpha0: float = 1.0, emit_most_likely: bool = True, threshold: float = 0.0,
    should_cluster: bool = True, model: str = "gaussian", seed: int = 0,
) -> tuple[list[Cluster], np.ndarray, DataFrame | None]:
    """Models with points, the mixture over all models, and the clustered points.

    Each iteration draws a model for every point, then means, deviations and
    mixture from what the points of each model say. ``emit_most_likely``: one
    row per point; otherwise a row for every model whose share of the point is at
    least ``threshold``, with the share as ``probability``. Dense and sparse points alike.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {', '.join(MODELS)}")
    found = gibbs(points, num_models, iterations, alpha0, seed)
    if found is None:
        return [], np.full(num_models, 1 / num_models), None
    mixture, means, deviations, counts = found
    clusters = [Cluster(k, means[k], deviations[k], int(counts[k])) for k in range(num_models) if counts[k]]
    if not should_cluster:
        return clusters, mixture, None
    return clusters, mixture, assign_models(points, mixture, means, deviations, emit_most_likely, threshold)


def assign_models(points: DataFrame, mixture: np.ndarray, means: np.ndarray, deviations: np.ndarray, emit_most_likely: bool = True, threshold: float = 0.0) -> DataFrame:
    """points by their most likely model (``cluster``), or a row for each model whose share is at least ``threshold`` (``probability``, ``cluster``); one pass."""
    if emit_most_likely:
        return assign(points, lambda b: posterior(b, mixture, means, deviations).argmax(1), blocks=True)
    shares = assign(points, lambda b: posterior(b, mixture, means, deviations), T.ArrayType(T.DoubleType()), "_shares", blocks=True)
    each = shares.select(*points.columns, F.posexplode("_shares").alias("cluster", "probability"))
    return each.where(F.col("probability") >= threshold).select(*points.columns, "probability", "cluster")
