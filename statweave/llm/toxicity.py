"""Toxicity scores by a chain of linear classifiers.

Categories are predicted one after another.  The model of a category sees the
text's features and the probabilities of all earlier categories.  In training
these come from models that have not seen the row: the training rows are dealt
into folds, and each fold is scored by a model fitted on the others (features
are chosen anew there too).  At scoring time the earlier models' own
probabilities take their place.

Features are presence flags of words and of their first 4, 5 and 6 bytes, so
that a stem counts under any ending, hashed to ``BITS`` bits.  A model keeps the ``FEATURES`` features
that a likelihood-ratio test ranks first, as far as chance does not explain them
(``LEAST_GAIN``), and is fitted by L-BFGS with an L2
penalty.  Documents are rejected from that probability of the last category on
that parts the training rows best (by F1) when each is scored by models that have not seen it.

Training uses at most ``TRAIN_ROWS`` labelled rows, those with the least hash of
doc_id, and all features of their texts.  An aggregate over these finds the features that any of
the fits could keep, and only these come to the driver; so the model
has a bounded size and goes to all tasks.
Scoring is one pass without a shuffle.

Defined results: a null text is empty and gets the probabilities of a text
without features; a category learns from the rows whose labels decide it (a null label
of another kind does no harm), of repeated labels the
greatest counts, and of documents with one labelled doc_id the least text is
learnt from; without labels of both kinds a category gets their share (0
where there are none); rows repeat as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, Words, blocks, map_arrow, span_hashes, text_buffer
from .licenses import WORD_BYTES

TRAIN_ROWS = 8000
FEATURES = 4096
#: Log likelihood that a feature has to gain: three occurrences, all in a category of a tenth of the rows, just fail to.
LEAST_GAIN = 7.0
FOLDS = 3
PENALTY = 1.0
PREFIXES = (4, 5, 6)
BITS = 22
#: category -> the SQL condition on the columns of ``labels`` that it stands for; in the order of the chain.
CHAIN = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
}


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each text (int32, below 2 ** BITS)."""
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets, 1 << 20):
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        words = Words(part, own, WORD_BYTES)
        size = words.ends - words.starts
        text = np.repeat(np.arange(j - i), np.diff(words.first))
        found, of = [words.hashes], [text]
        for n in PREFIXES:
            long = size >= n
            found.append(span_hashes(part, words.starts[long], words.starts[long] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            of.append(text[long])
        found, of = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(j - i + 1))
        found = found[order]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(found[a:b])


class Rows:
    """Sparse rows of feature numbers."""

    def __init__(self, counts: np.ndarray, columns: np.ndarray):
        self.counts, self.columns = counts, columns
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    def take(self, which: np.ndarray) -> Rows:
        mask = np.zeros(len(self.counts), bool)
        mask[which] = True
        return Rows(self.counts[mask], self.columns[mask[self.row]])


class Model(NamedTuple):
    features: np.ndarray  # feature numbers, sorted
    weights: np.ndarray  # theirs, then those of the earlier categories' log odds, then the constant


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def probabilities(model: Model, row: np.ndarray, column: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    """P of n texts; ``row``, ``column``: features that occur in them; ``earlier``: n x categories so far."""
    z = np.full(n, model.weights[-1])
    if len(model.features):
        at = np.minimum(np.searchsorted(model.features, column), len(model.features) - 1)
        hit = model.features[at] == column
        z += np.bincount(row[hit], model.weights[at[hit]], n)
    if earlier.shape[1]:
        z += log_odds(earlier) @ model.weights[len(model.features) : -1]
    return 1 / (1 + np.exp(-z))


def fit(x: Rows, y: np.ndarray, earlier: np.ndarray, keep: int = FEATURES) -> Model:
    """Choose features and fit; y: 0 or 1 for each row."""
    n, good = len(y), y.sum()
    if not 0 < good < n:
        p = (good / n if n else 0.0) * (1 - 2e-6) + 1e-6
        return Model(np.zeros(0, np.int32), np.append(np.zeros(earlier.shape[1]), log_odds(np.array(p))))
    width = 1 << BITS
    seen = np.bincount(x.columns, minlength=width)
    some = np.flatnonzero(seen >= 3)
    with_ = np.bincount(x.columns[(y > 0)[x.row]], minlength=width)[some]
    gain = _likelihood_ratio(with_.astype(float), seen[some].astype(float), good, n)
    best = np.sort(some[np.argsort(-gain, kind="stable")[: min(keep, int((gain >= LEAST_GAIN).sum()))]]).astype(np.int32)
    at = np.full(width, -1, np.int32)
    at[best] = np.arange(len(best), dtype=np.int32)
    column = at[x.columns]
    row, column, k = x.row[column >= 0], column[column >= 0], len(best)
    dense = np.hstack([log_odds(earlier), np.ones((n, 1))])
    penalty = np.full(k + dense.shape[1], PENALTY)
    penalty[-1] = 1e-4

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[column], n) + dense @ w[k:]
        p = 1 / (1 + np.exp(-z))
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()
        return value, np.concatenate([np.bincount(column, (p - y)[row], k), dense.T @ (p - y)]) + penalty * w

    return Model(best, lbfgs(loss, np.zeros(k + dense.shape[1])))


def _likelihood_ratio(with_: np.ndarray, seen: np.ndarray, good: float, n: int) -> np.ndarray:
    """G statistic of a 2 x 2 table for each feature."""
    total = 0
    for a, r, c in ((with_, seen, good), (seen - with_, seen, n - good), (good - with_, n - seen, good), (n - seen - good + with_, n - seen, n - good)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total = total + np.where(a > 0, a * np.log(a * n / (r * c)), 0)
    return total


def lbfgs(loss, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function given with its gradient."""
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, saved = -g, []
        for s, t, rho in reversed(past):
            saved.append(a := rho * (s @ d))
            d = d - a * t
        if past:
            s, t, rho = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, rho), a in zip(past, reversed(saved), strict=True):
            d = d + (a - rho * (t @ d)) * s
        step = 1.0 if past else 1 / max(1.0, np.abs(g).max())
        slope = g @ d
        while True:
            new, ng = loss(w + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, t = step * d, ng - g
        if s @ t > 1e-12:
            past = [*past[1 - memory :], (s, t, 1 / (s @ t))]
        done = value - new <= 1e-7 * max(1.0, abs(value))
        w, value, g = w + s, new, ng
        if done:
            break
    return w


class Chain(dict):
    """Models by category, and the probability of the last one from which on documents are rejected."""

    reject: float = 0.5


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on rows are called positive with the greatest F1, halfway to the next one below; 0.5 if there is nothing to part."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0  # equal rows go together
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def train_chain(x: Rows, ys: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """A model per category, each fitted on out-of-fold probabilities of the earlier ones; rows whose y is not a number take no part in its fits."""
    n = len(x.counts)
    earlier, models = np.zeros((n, 0)), Chain()
    for name, y in ys.items():
        known = ~np.isnan(y)

        def fitted(rows: np.ndarray, y: np.ndarray = y, earlier: np.ndarray = earlier) -> Model:
            return fit(x.take(rows), y[rows], earlier[rows])

        models[name], out = fitted(np.flatnonzero(known)), np.zeros(n)
        for f in range(FOLDS):
            inside = np.flatnonzero(folds == f)
            held = x.take(inside)
            out[inside] = probabilities(fitted(np.flatnonzero((folds != f) & known)), held.row, held.columns, len(inside), earlier[inside])
        earlier = np.column_stack([earlier, out])
        models.reject = best_cut(out[known], y[known])
    return models


def _candidates(rows: DataFrame, categories: int) -> np.ndarray:
    """The features that pass the test in the fit of any category, on all rows or without one of the folds."""
    y = [F.col(f"y{i}") for i in range(categories)]
    inside = [F.lit(True), *[F.col("fold") != f for f in range(FOLDS)]]
    sums = [g(F.when(s, c)).alias(f"{name}{k}_{i}") for k, s in enumerate(inside) for i, c in enumerate(y) for name, g in (("n", F.count), ("g", F.sum))]
    total = rows.agg(*sums).first()
    keys = [f"{k}_{i}" for k in range(len(inside)) for i in range(categories)]
    totals = {key: (total[f"n{key}"], total[f"g{key}"] or 0.0) for key in keys}

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for key, (n, g) in totals.items():
                if 0 < g < n:
                    seen, with_ = (batch.column(f"{c}{key}").fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in "ng")
                    good |= (seen >= 3) & (_likelihood_ratio(with_, seen, g, n) >= LEAST_GAIN)
            yield pa.RecordBatch.from_arrays([batch.column("f").filter(pa.array(good))], ["f"])

    counted = rows.select(F.explode("f").alias("f"), "fold", *y).groupBy("f").agg(*sums)
    return np.sort(map_arrow(counted, passing, "f int").toArrow()["f"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, chain: dict[str, str | Column] = CHAIN, rows: int = TRAIN_ROWS) -> Chain:
    """Models by category from at most ``rows`` labelled documents."""
    some = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    judged = [F.expr(e) if isinstance(e, str) else e for e in chain.values()]
    names = [f"y{i}" for i in range(len(chain))]
    some = some.select("doc_id", *[j.cast("double").alias(y) for y, j in zip(names, judged, strict=True)]).where(F.coalesce(*names).isNotNull())
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # Of rows that repeat a labelled doc_id the least text counts, so that there are no more texts than labels.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    kept = ["doc_id", "fold", *names]

    def lists(sets: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, sets)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy().astype(np.uint64)
            folds = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(FOLDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(folds.astype(np.int32)), *(batch.column(y) for y in names), lists(list(features(batch.column("text"))))], [*kept, "f"])

    schema = "doc_id long, fold int, " + ", ".join(f"{y} double" for y in names) + ", f array<int>"
    held = Stored(map_arrow(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *names), run, schema))
    wanted = docs.sparkSession.sparkContext.broadcast(_candidates(held.df, len(chain)))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy() for x in batch.column("f")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists([s[np.isin(s, wanted.value, kind="sort")] for s in sets])], [*kept, "f"])

    made = map_arrow(held.df, trim, schema).toArrow().sort_by("doc_id")
    held.drop()
    f = made["f"].combine_chunks()
    counts = f.value_lengths().to_numpy(zero_copy_only=False).astype(int) if len(f) else np.zeros(0, int)
    ys = {name: made[y].to_numpy() for y, name in zip(names, chain, strict=True)}
    return train_chain(Rows(counts, f.flatten().to_numpy()), ys, made["fold"].to_numpy())


def score(docs: DataFrame, models: dict[str, Model], prefix: str = "p_") -> DataFrame:
    """docs with a probability p_<category> for each category (columns of that name are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"{prefix}{name}" for name in models]
    kept = docs.drop(*names)
    text, columns = kept.columns.index("text"), [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        wanted = np.unique(np.concatenate([m.features for m in chain.values()]))
        for batch in batches:
            n, row, column = batch.num_rows, [], []
            for i, found in enumerate(features(batch.column(text))):
                if len(wanted) and len(found):
                    found = found[wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found]
                    row.append(np.full(len(found), i))
                    column.append(found)
            row = np.concatenate(row) if row else np.zeros(0, int)
            column = np.concatenate(column) if column else np.zeros(0, np.int32)
            earlier = np.zeros((n, 0))
            for m in chain.values():
                earlier = np.column_stack([earlier, probabilities(m, row, column, n, earlier)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(earlier[:, k]) for k in range(len(names)))], columns)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return map_arrow(kept, run, StructType([*kept.schema.fields, *(StructField(x, DoubleType()) for x in names)]))
