"""Operators on rows: count, samples, filter, map, vectors, normalisation. None but the exact sample shuffles."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.parsing import number
from ..sources.schema import DOUBLE, field_of
from ..sources.storage import Stored


def count_lines(df: DataFrame) -> DataFrame:
    """One row: the number of rows, those of nulls included."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def drawn(seed: int, key: list[str]) -> Column:
    """A number in (0, 1) for each row, from the md5 of the seed and the key's columns as text, with colons between (nulls as nothing)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / 16.0**13


def sample_bernoulli(df: DataFrame, probability: float, seed: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Each row with the given probability; one generator seed for the run.

    ``key``: columns that tell rows apart. A row is then in the sample or not by
    itself, however the table lies in partitions; without a key that depends on them.
    """
    seed = seed if seed is not None else random.randrange(1 << 31)
    return df.where(drawn(seed, key) < probability) if key else df.sample(False, probability, seed)


def sample_exact(df: DataFrame, fraction: float, total: int | None = None, seed: int = 0, buckets: int = 1 << 16, key: list[str] | None = None) -> DataFrame:
    """round(total * fraction) rows without replacement, each with equal chance, in the order of the table's rows.

    The sample is of the rows with the least numbers: of ``drawn`` from the ``key``,
    so that it doesn't depend on partitions (rows of one key follow one another), or,
    without a key, random ones.  Rows get their number once: those that may belong to the sample are stored
    with it (a few more than asked for), so that what is counted is what is taken.
    A count by its ``buckets`` ranges, which combines before the shuffle, finds the range in which the sample is full,
    and only rows of that one range are put in order.
    """
    total = df.count() if total is None else total
    n = int(total * fraction + 0.5)
    share = n / total if total else 0.0
    most = min(1.0, share + 6 * math.sqrt(share * (1 - share) / max(1, total)) + 10 / max(1, total))
    draws = df.withColumns({"_draw": drawn(seed, key) if key else F.rand(seed), "_id": F.monotonically_increasing_id()})
    found = Stored(draws.where(F.col("_draw") < most))
    if most < 1 and found.df.count() < n:  # hardly ever
        found.drop()
        most, found = 1.0, Stored(draws)
    rows = found.df
    place = F.least(F.floor(F.col("_draw") / most * buckets), F.lit(buckets - 1)).cast("int")
    left, cut = n, buckets
    for b, c in sorted(tuple(r) for r in rows.groupBy(place.alias("b")).count().collect()):  # at most ``buckets`` rows
        if c > left:
            cut = b
            break
        left -= c
    whole = rows.where(place < cut)
    if cut < buckets and left > 0:
        whole = whole.union(rows.where(place == cut).orderBy("_draw", "_id").limit(left))
    return whole.orderBy("_id").drop("_draw", "_id")


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> tuple[Stored, DataFrame]:
    """The rows in order with their place from 0: the stored table, and a DataFrame that reads it.

    The sort goes by ranges; the rows of each range, a number per partition, turn
    places in a partition into places in the whole.
    """
    held = Stored(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(name, 33)
    before, starts = 0, []
    for p, n in held.df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).sort("part").collect():  # a row per partition
        starts.append((p, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    placed = held.df.join(starts, part == F.col("_part")).withColumn(name, F.col("_start") + F.col(name).bitwiseAND((1 << 33) - 1))
    return held, placed.select(*df.columns, name)


def draw(df: DataFrame, k: int, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """k rows by chance (all, if there are fewer), for small k: the rows with the least numbers, ``drawn`` from the ``key`` or random."""
    return df.withColumn("_draw", drawn(seed, key) if key else F.rand(seed)).orderBy("_draw").limit(k).drop("_draw")


@dataclass(frozen=True)
class Batches:
    """A user's function of many rows at a time, for ``filter_table``, ``map_table`` and ``vectorize``.

    ``form``: "arrow", a function of a pyarrow RecordBatch, or "pandas", one of a
    DataFrame.  It runs on one Arrow batch after another, as Spark deals them, so a row's
    result must not hang on the others.  An exception ends the job.

    A filter gives a value for each row (Arrow array, Series, numpy array or list; only
    True keeps a row), a map a RecordBatch or Table, or a DataFrame, with the
    columns of the schema (by name; in any order, others are left out), and a
    vectorizer a list of numbers for each row, or a matrix (rows without one are left out).
    """

    function: Callable
    form: str = "arrow"

    def __post_init__(self) -> None:
        if self.form not in ("arrow", "pandas"):
            raise ValueError(f"unknown form {self.form!r}; arrow or pandas")

    def __call__(self, batch: pa.RecordBatch) -> object:
        return self.function(batch.to_pandas() if self.form == "pandas" else batch)

    def column(self, batch: pa.RecordBatch, kind: pa.DataType) -> pa.Array:
        """The function's value for each row as an Arrow array."""
        made = self(batch)
        if isinstance(made, pa.ChunkedArray):
            made = made.combine_chunks()
        if not isinstance(made, pa.Array):
            made = pa.array(list(made) if getattr(made, "ndim", 1) > 1 else made, from_pandas=True)
        if len(made) != batch.num_rows:
            raise ValueError(f"{len(made)} values for {batch.num_rows} rows")
        return made.cast(kind)

    def table(self, batch: pa.RecordBatch, schema: pa.Schema) -> pa.Table:
        made = self(batch)
        if isinstance(made, pa.RecordBatch):
            made = pa.Table.from_batches([made])
        elif not isinstance(made, pa.Table):
            made = pa.Table.from_pandas(made, preserve_index=False)
        return made.select(schema.names).cast(schema)


def arrow_function(function: Callable[[pa.RecordBatch], object]) -> Batches:
    return Batches(function)


def pandas_function(function: Callable) -> Batches:
    return Batches(function, "pandas")


def filter_table(df: DataFrame, condition: Column | str | Batches | Callable[[dict], bool]) -> DataFrame:
    """Rows for which the condition is true; null counts as false.

    Give a Column or SQL text where possible, or a function of many rows
    (``arrow_function``, ``pandas_function``). A Python function of a row as dict
    works too: only True keeps a row, an exception drops it.
    """
    if isinstance(condition, (Column, str)):
        return df.where(condition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(condition, Batches):
                keep = condition.column(batch, pa.bool_())
            else:
                keep = pa.array([_true(condition, r) for r in batch.to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return df.mapInArrow(run, df.schema)


def _true(condition: Callable[[dict], bool], row: dict) -> bool:
    try:
        return condition(row) is True
    except Exception:
        return False


def map_table(df: DataFrame, function: dict[str, Column | str] | Batches | Callable[[dict], dict], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows turned into others: by columns (name -> expression, all others stay), by a function of many rows, or by one of a row as dict; these give rows of ``schema`` (the input's, if none is given)."""
    if isinstance(function, dict):
        return df.withColumns({k: F.expr(e) if isinstance(e, str) else e for k, e in function.items()})
    to = schema or df.schema
    wanted = to_arrow_schema(T.StructType.fromDDL(to) if isinstance(to, str) else to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(function, Batches):
                yield from function.table(batch, wanted).to_batches()
            else:
                yield pa.RecordBatch.from_pylist([function(r) for r in batch.to_pylist()], schema=wanted)

    return df.mapInArrow(run, to)


def _numbers(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as doubles; text can't be one, so such a column is null in every row."""
    out = []
    for name in columns:
        f = field_of(df.schema, name)
        c = number(df[f.name], f)
        out.append(F.lit(None).cast("double") if c is None else c)
    return out


def _by_function(df: DataFrame, function: Batches, keep: list[str]) -> DataFrame:
    kept = df.select(*keep).schema.fields
    kind, at = pa.list_(pa.float64()), [df.columns.index(f.name) for f in kept]
    names = [*(f.name for f in kept), "point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), function.column(batch, kind)], names)

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("point", T.ArrayType(T.DoubleType()))]))


def vectorize(df: DataFrame, columns: list[str] | Batches, vector_type: str = "dense", keep: list[str] = ()) -> DataFrame:
    """One vector per row of the columns' values in the given order, or of what a function of many rows gives; rows that lack one are left out.

    "dense": ``point`` array<double>. The sparse types: ``size`` and ``entries``,
    a map from position to value without zeros. ``keep``: columns to carry along.
    """
    if vector_type not in ("dense", "sparse", "sequential-sparse", "random-access-sparse"):
        raise ValueError(f"unknown type of vector {vector_type!r}")
    made = _by_function(df, columns, keep) if isinstance(columns, Batches) else df.select(*keep, F.array(*_numbers(df, columns)).alias("point"))
    point = made.where(F.forall("point", lambda x: x.isNotNull()))
    if vector_type == "dense":
        return point
    entries = F.filter(F.transform("point", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return point.select(*keep, F.size("point").alias("size"), F.map_from_entries(entries).alias("entries"))


def normalize(df: DataFrame, columns: list[str], minima: list[float], maxima: list[float]) -> DataFrame:
    """(x - min) / (max - min) of the columns, with bounds that the caller supplies; rows that lack a value are left out.

    Where the bounds are equal the result is that of the division of doubles by zero.
    """
    if not len(columns) == len(minima) == len(maxima):
        raise ValueError("each column needs a minimum and a maximum")
    plain = df.select(*[c.alias(name) for c, name in zip(_numbers(df, columns), columns, strict=True)]).where(_all_there(columns))
    made = []
    for name, lo, hi in zip(columns, minima, maxima, strict=True):
        top, size = F.col(name) - F.lit(float(lo)), float(hi) - float(lo)
        ratio = top / F.lit(size) if size else F.when(top > 0, float("inf")).when(top < 0, float("-inf")).otherwise(float("nan"))
        made.append(ratio.alias(name, metadata={"kind": DOUBLE}))
    return plain.select(*made)


def _all_there(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
