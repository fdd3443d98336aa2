"""Distances and moves between array<double> columns, as built-in expressions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def segmental(medoid: Column, dims: Column, v: Column) -> Column:
    """Sum of |m - v| over the medoid's selected dimensions (positions from 0)."""
    return F.aggregate(dims, F.lit(0.0), lambda s, d: s + F.abs(F.get(medoid, d) - F.get(v, d)))


DISTANCES = {"euclidean": euclidean}


def build_distance(name: str):
    """The distance of that name; unknown names give the Euclidean one, as scripts expect."""
    return DISTANCES.get(name, euclidean)


def check_distance(name: str) -> None:
    """Warn where a name isn't known, as the Euclidean distance then stands for it."""
    if name not in DISTANCES:
        warnings.warn(f"unknown distance {name!r}; the Euclidean one is used", stacklevel=3)


def to_point(columns: list[Column]) -> Column:
    return F.array(*[c.cast("double") for c in columns])
