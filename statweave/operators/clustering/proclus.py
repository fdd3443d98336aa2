"""Projected clustering (PROCLUS): medoids with a set of dimensions each.

The published algorithm, with an objective averaged over all dimensions, segmental
distances that aren't divided by the number of dimensions, and each cluster's
share of the objective divided by k as well, which fixes the meaning of
``min_threshold``.  Medoids and their statistics live on the driver; each phase is
one pass over the points with sums per medoid.  First medoids are chosen from a
Bernoulli sample of any size, which stays distributed: each choice is one pass in
which every task passes on its farthest point.  Sample and order are those of hashes
of the points, so a run is a function of the data and the seed.

An iteration is one pass: it evaluates a set of medoids, and gathers beside it what
the next set's dimensions follow from.  That set isn't known yet, but what it is made
of is: the best medoids so far, the present ones, and the next few in line.  For each
of these the points' deviations are added up by their distance, between the distances of
all the others; sums up to any other one are sums over a locality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import assign, fold, group_sums, kept, order_key, uniforms

@dataclass(frozen=True)
class Medoid:
    id: int
    vector: np.ndarray
    dims: np.ndarray
    delta: float
    center: np.ndarray
    n: int


def in_order(points: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n different points that come first in an order by hash (ties by the points themselves)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), order_key(F.col("point"))))
    return np.array([r[0] for r in points.select("point").distinct().orderBy(key, "point").limit(n).collect()], float)


def farthest(points: DataFrame, chosen: np.ndarray) -> tuple[float, np.ndarray]:
    """The greatest of the points' least distances (summed over all dimensions) to those chosen, and its point (of equals the greatest)."""

    def away(x: np.ndarray) -> np.ndarray:
        return np.min([np.abs(x - c).sum(1) for c in chosen], axis=0)

    far = assign(points.select("point"), away, T.DoubleType(), "away").agg(F.max(F.struct("away", "point"))).first()[0]
    return far["away"], np.array(far["point"])


def greedy(sample: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """The first point by hash, then k - 1 times the farthest one from those chosen."""
    chosen = in_order(sample, 1, seed)
    while 0 < len(chosen) < k:
        away, point = farthest(sample, chosen)
        if away <= 0:
            return chosen  # no other point is left
        chosen = np.vstack([chosen, point])
    return chosen


def radii(medoids: np.ndarray) -> np.ndarray:
    """The Euclidean distance of each medoid to the nearest other one; infinite for a single medoid."""
    d = np.sqrt(((medoids[:, None] - medoids[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d.min(1)


def segmental(x: np.ndarray, medoids: np.ndarray, dims: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.abs(x[:, d] - m[d]).sum(1) for m, d in zip(medoids, dims, strict=True)], 1)


def locality_means(points: DataFrame, medoids: np.ndarray, deltas: np.ndarray, dims: list[np.ndarray] | None = None) -> np.ndarray:
    """Mean |x - medoid| per dimension over each medoid's locality (points within its radius); with ``dims`` only over points of its own cluster."""

    def part(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = segmental(x, medoids, dims).argmin(1) if dims is not None else None
        keys, rows = [], []
        for i, (m, delta) in enumerate(zip(medoids, deltas, strict=True)):
            inside = np.sqrt(((x - m) ** 2).sum(1)) <= delta
            if own is not None:
                inside &= own == i
            if inside.any():
                keys.append(i)
                rows.append(np.append(inside.sum(), np.abs(x[inside] - m).sum(0)))
        return np.array(keys, int), np.array(rows)

    out = np.zeros(medoids.shape)
    for i, s in fold(points, part).items():
        out[i] = s[1:] / s[0]
    return out


def select_dimensions(means: np.ndarray, l: int) -> list[np.ndarray]:  # noqa: E741
    """Two dimensions of least deviation for each medoid, then the least of all until there are k * l."""
    k, d = means.shape
    sigma = means.std(1, ddof=1) if d > 1 else np.ones(k)
    z = (means - means.mean(1, keepdims=True)) / np.where(sigma > 0, sigma, 1)[:, None]
    order = np.argsort(z, 1, kind="stable")
    chosen = [list(order[i, : min(2, d)]) for i in range(k)]
    rest = sorted((z[i, j], i, j) for i in range(k) for j in order[i, 2:])
    for _, i, j in rest[: max(0, k * (min(l, d) - 2))]:
        chosen[i].append(j)
    return [np.sort(np.array(c, int)) for c in chosen]


def _evaluated(x: np.ndarray, medoids: np.ndarray, dims: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own = segmental(x, medoids, dims).argmin(1)
    return group_sums(own, np.hstack([np.ones((len(x), 1)), np.abs(x - medoids[own]), x]))


def _verdict(sums: dict[int, np.ndarray], medoids: np.ndarray, min_deviation: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    k, d = medoids.shape
    n, w, centers = np.zeros(k), np.zeros(k), medoids.copy()
    for i, s in sums.items():
        n[i], w[i], centers[i] = s[0], (s[1 : d + 1] / s[0]).mean(), s[d + 1 :] / s[0]
    good = n >= n.sum() / k * min_deviation
    good[n.argmin()] = False
    return float((w / k * n).sum() / max(1, n.sum())), n, centers, good


def evaluate(points: DataFrame, medoids: np.ndarray, dims: list[np.ndarray], min_deviation: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Objective, point counts, centroids, and which medoids are good."""
    return _verdict(fold(points, lambda x: _evaluated(x, medoids, dims)), medoids, min_deviation)


class Localities:
    """Sums of the points' deviations from each of some vectors, by distance: between the distances of the other vectors, in order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, (self.u, self.d) = vectors, vectors.shape
        away = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
        np.fill_diagonal(away, np.inf)
        self.limits = np.sort(away, 1)
        self.sums = np.zeros((self.u, self.u, self.d + 1))

    def part(self, x: np.ndarray, first: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Keys from ``first`` on, and their rows: number and sum of deviations."""
        keys, rows = [], []
        for a, m in enumerate(self.vectors):
            at = np.searchsorted(self.limits[a], np.sqrt(((x - m) ** 2).sum(1)), "left")
            found, sums = group_sums(np.minimum(at, self.u - 1), np.hstack([np.ones((len(x), 1)), np.abs(x - m)]))
            keys.append(first + a * self.u + found)
            rows.append(sums)
        return keys, rows

    def add(self, key: int, row: np.ndarray) -> None:
        self.sums[key // self.u, key % self.u] += row

    def means(self, medoids: np.ndarray) -> np.ndarray:
        """As ``locality_means`` has them, for medoids among the vectors."""
        out = np.zeros(medoids.shape)
        for i, (m, delta) in enumerate(zip(medoids, radii(medoids), strict=True)):
            a = int(np.flatnonzero((self.vectors == m).all(1))[0])
            total = self.sums[a][self.limits[a] <= delta].sum(0)
            out[i] = total[1:] / max(1, total[0])
        return out


def one_pass(points: DataFrame, medoids: np.ndarray, dims: list[np.ndarray] | None, vectors: np.ndarray, min_deviation: float) -> tuple[tuple | None, Localities]:
    """What ``evaluate`` gives for the medoids (if they have dimensions yet), and the localities of the vectors."""
    k, near = len(medoids), Localities(vectors)

    def part(x: np.ndarray) -> tuple[list, list]:
        keys, rows = near.part(x, k)
        if dims is not None:
            own, sums = _evaluated(x, medoids, dims)
            keys, rows = [own, *keys], [sums, *rows]
        return [k for ks in keys for k in ks], [r for rs in rows for r in rs]

    sums = fold(points, part)
    for key in [key for key in sums if key >= k]:
        near.add(key - k, sums.pop(key))
    return None if dims is None else _verdict(sums, medoids, min_deviation), near


def _distinct(*sets: np.ndarray) -> np.ndarray:
    return np.unique(np.vstack([s for s in sets if len(s)]), axis=0)


def proclus(
    points: DataFrame, k: int, l: int, iterations: int = 10, min_deviation: float = 0.1, split_size: float = 0.2, min_threshold: float = 0.0, seed: int = 0,  # noqa: E741
) -> tuple[list[Medoid], float, DataFrame]:
    """Medoids, objective, and clustered points (a ``cluster`` column; outliers are left out).

    In iteration i bad medoids give way to the next ones in line: of the sample's
    points in order, the 2 k ones from place 2 k i on, without those that are medoids.
    """
    if k < 1 or l < 2:
        raise ValueError("k >= 1 and l >= 2 are needed")
    held, rounds = kept(points.select("point")), max(1, iterations)
    try:
        sample = held.where(uniforms(held, seed, "split") < split_size) if split_size < 1 else held
        now, best = greedy(sample, k, seed), None
        if len(now) < k:
            sample, now = held, greedy(held, k, seed)
        if len(now) < k:
            raise ValueError(f"{len(now)} different points are fewer than k = {k}")
        line = in_order(sample, 2 * k * rounds, seed + 1)
        _, near = one_pass(held, now, None, now, min_deviation)
        for it in range(rounds):
            dims, pool = select_dimensions(near.means(now), l), line[2 * k * it : 2 * k * (it + 1)]
            (objective, _, _, good), near = one_pass(held, now, dims, _distinct(now, pool, *([best[1]] if best else [])), min_deviation)
            if best is None or objective < best[0]:
                best = objective, now, good
            if best[0] < min_threshold:
                break
            others = [p for p in pool if not (best[1] == p).all(1).any()]
            now = best[1].copy()
            for i, p in zip(np.flatnonzero(~best[2]), others, strict=False):
                now[i] = p
        medoids = best[1]
        deltas = radii(medoids)
        dims = select_dimensions(near.means(medoids), l)
        dims = select_dimensions(locality_means(held, medoids, deltas, dims), l)
        objective, n, centers, _ = evaluate(held, medoids, dims, min_deviation)
    finally:
        held.unpersist()
    found = [Medoid(i, medoids[i], dims[i], float(deltas[i]), centers[i], int(n[i])) for i in range(k)]
    return found, objective, members(points, found)


def members(points: DataFrame, medoids: list[Medoid]) -> DataFrame:
    """points by their nearest medoid (``cluster``), those within its radius; others are outliers and left out."""
    vectors, dims, deltas = np.array([m.vector for m in medoids]), [m.dims for m in medoids], np.array([m.delta for m in medoids])

    def pick(x: np.ndarray) -> np.ndarray:
        d = segmental(x, vectors, dims)
        own = d.argmin(1)
        return np.where(d[np.arange(len(x)), own] < deltas[own], own, -1)

    return assign(points, pick).where("cluster >= 0")


def plot_radius(m: Medoid) -> np.ndarray:
    """The medoid's radius dealt over its dimensions in proportion to its coordinates there; 0 elsewhere."""
    out, total = np.zeros(len(m.vector)), np.abs(m.vector[m.dims]).sum()
    out[m.dims] = m.delta * (np.abs(m.vector[m.dims]) / total if total else 1 / len(m.dims))
    return out
