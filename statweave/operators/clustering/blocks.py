"""Batches of points inside a task: dense matrices and compressed rows, with the few products that clustering takes.

Squared distances to centers come from one matrix product, |x|^2 + |c|^2 - 2 x c,
which rounding can turn around where distances nearly agree.  Every decision (which
center is nearest, what lies within a radius) is therefore made anew from
differences wherever the product's error could change it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Distances that are held at a time: 16 MB.
CELLS = 1 << 21


class Dense:
    """Points as a matrix."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.d) = x, x.shape

    def take(self, rows: np.ndarray | slice) -> Dense:
        return Dense(self.x[rows])

    def dense(self) -> np.ndarray:
        return self.x

    def squared(self) -> Dense:
        return Dense(self.x * self.x)

    def weighted(self, n: np.ndarray) -> Dense:
        return Dense(self.x * n[:, None])

    def norms(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x, self.x)

    def products(self, c: np.ndarray) -> np.ndarray:
        """x c for each point and center."""
        return self.x @ c.T

    def pairs(self, rows: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of some points to a center each, by differences."""
        out = np.empty(len(rows))
        step = max(1, CELLS // max(1, self.d))
        for s in range(0, len(rows), step):
            e = self.x[rows[s : s + step]] - c[which[s : s + step]]
            out[s : s + step] = np.einsum("ij,ij->i", e, e)
        return out

    def scaled(self, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Sum of ((x - center) / scale) ** 2 for each point."""
        return (((self.x - center) / scale) ** 2).sum(1)

    def sums(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Sums of the points of each key below k."""
        out = np.zeros((k, self.d))
        np.add.at(out, keys, self.x)
        return out

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        """weights' x: for each column of weights (points x k) the weighted sum of points."""
        return weights.T @ self.x


class Sparse:
    """Points as compressed rows: positions and values of what isn't zero."""

    def __init__(self, d: int, ends: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.d, self.n, self.ends, self.at, self.value = d, len(ends) - 1, ends, at, value
        self.row = np.repeat(np.arange(self.n), np.diff(ends))

    def take(self, rows: np.ndarray | slice) -> Sparse:
        rows = np.arange(self.n)[rows]
        size = np.diff(self.ends)[rows]
        ends = np.append(0, np.cumsum(size))
        where = np.arange(ends[-1]) + np.repeat(self.ends[:-1][rows] - ends[:-1], size)
        return Sparse(self.d, ends, self.at[where], self.value[where])

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.d))
        out[self.row, self.at] = self.value
        return out

    def squared(self) -> Sparse:
        return Sparse(self.d, self.ends, self.at, self.value * self.value)

    def weighted(self, n: np.ndarray) -> Sparse:
        return Sparse(self.d, self.ends, self.at, self.value * n[self.row])

    def norms(self) -> np.ndarray:
        return self._by_row(self.value * self.value)

    def _by_row(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.n)

    def products(self, c: np.ndarray) -> np.ndarray:
        if self.n * self.d <= CELLS:
            return self.dense() @ c.T
        out = np.empty((self.n, len(c)))
        for k in range(len(c)):
            out[:, k] = self._by_row(self.value * c[k, self.at])
        return out

    def pairs(self, rows: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
        some = self.take(rows)
        own = c[which[some.row], some.at]
        # Differences where a value is, and the center's own squares elsewhere.
        rest = np.einsum("ij,ij->i", c, c)[which]
        return np.maximum(0, rest + some._by_row((some.value - own) ** 2 - own * own))

    def scaled(self, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
        empty = (center / scale) ** 2
        return np.maximum(0, empty.sum() + self._by_row(((self.value - center[self.at]) / scale[self.at]) ** 2 - empty[self.at]))

    def sums(self, keys: np.ndarray, k: int) -> np.ndarray:
        flat = np.bincount(keys[self.row] * self.d + self.at, self.value, k * self.d)
        return flat.reshape(k, self.d)

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        if self.n * self.d <= CELLS:
            return weights.T @ self.dense()
        out = np.zeros((weights.shape[1], self.d))
        for k in range(len(out)):
            out[k] = np.bincount(self.at, self.value * weights[self.row, k], self.d)
        return out


Block = Dense | Sparse


def block(columns: list[pa.Array]) -> Block:
    """A list column as a dense block, or a size and a map column as a sparse one; without nulls."""
    if len(columns) == 1:
        n = len(columns[0])
        flat = columns[0].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return Dense(flat.reshape(n, -1) if n else np.zeros((0, 0)))
    size, entries = columns
    ends = entries.offsets.to_numpy().astype(np.int64)
    at = entries.keys.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    value = entries.items.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    d = int(size.to_numpy().max()) if len(size) else 0
    return Sparse(d, ends - ends[0], at, value)


def steps(b: Block, k: int):
    """The block in parts of so many points that their distances to k centers are CELLS at most: where each begins, and the part."""
    step = max(1, CELLS // max(1, k))
    for s in range(0, b.n, step):
        yield s, b if step >= b.n else b.take(slice(s, s + step))


def _about(b: Block, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one product, and a bound of their error for each point."""
    own, centers = b.norms(), np.einsum("ij,ij->i", c, c)
    slack = 4e-16 * (c.shape[1] + 8) * (own + (centers.max() if len(c) else 0.0))
    return own[:, None] + centers[None, :] - 2 * b.products(c), slack


def nearest(b: Block, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest center of each point (the first of equals), its squared distance, and a lower bound of that to any other center."""
    which, near, other = np.zeros(b.n, np.int64), np.zeros(b.n), np.full(b.n, np.inf)
    for s, part in steps(b, len(c)):
        about, slack = _about(part, c)
        close = about <= (about.min(1) + 2 * slack)[:, None]
        own = about.argmin(1)
        rows = np.flatnonzero(close.sum(1) > 1)
        if len(rows):
            i, j = np.nonzero(close[rows])
            exact = part.pairs(rows[i], c, j)
            order = np.lexsort((j, exact, i))
            first = np.flatnonzero(np.append(True, np.diff(i[order]) != 0))
            own[rows] = j[order][first]
        here = slice(s, s + part.n)
        which[here], near[here] = own, part.pairs(np.arange(part.n), c, own)
        if len(c) > 1:
            about[np.arange(part.n), own] = np.inf
            other[here] = np.maximum(0, about.min(1) - 2 * slack)
    return which, near, other


def within(b: Block, c: np.ndarray, radius: float) -> np.ndarray:
    """Which centers lie nearer than ``radius`` to each point (points x centers)."""
    about, slack = _about(b, c)
    out = about < radius * radius
    i, j = np.nonzero(np.abs(about - radius * radius) <= (slack + 1e-15 * radius * radius)[:, None])
    if len(i):
        out[i, j] = np.sqrt(b.pairs(i, c, j)) < radius
    return out
