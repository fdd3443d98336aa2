"""Reading and writing tables.

``import_dataset`` writes a typed Parquet copy of delimited text; ``wrap_dataset``
reads the text in place with the same rules.  Both are lazy plans up to the
write, cut lines with a regular expression, pad short lines with nulls and drop
extra cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import NULLS, null_if_token, parse_datum
from . import files
from .schema import column_position, field_of, kind_of, numeric_columns


@dataclass
class Dataset:
    """A table: its rows as a DataFrame, and the folder of its Parquet copy if it has one."""

    df: DataFrame
    path: str | None = None

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def ordered_columns(self) -> list[str]:
        return self.df.columns

    def numeric_columns(self) -> list[str]:
        return numeric_columns(self.schema)

    def column_position(self, name: str) -> int:
        return column_position(self.schema, name)

    def column_type(self, name: str) -> str:
        return kind_of(field_of(self.schema, name))

    def rows(self) -> Iterator[Row]:
        """All rows, a partition at a time."""
        return self.df.toLocalIterator()

    def points(self, column: str) -> DataFrame:
        """One column alone."""
        return self.df.select(field_of(self.schema, column).name)

    def view(self, name: str) -> Dataset:
        """Make the table known to SQL."""
        self.df.createOrReplaceTempView(name)
        return self

    def write(self, path: str | None = None) -> Dataset:
        return write_table(self, path)


Table = Dataset | DataFrame | str


def as_df(spark: SparkSession, table: Table) -> DataFrame:
    """A table given as Dataset, DataFrame or path."""
    if isinstance(table, Dataset):
        return table.df
    return spark.read.parquet(table) if isinstance(table, str) else table


def _lines(spark: SparkSession, path: str, skip: int, line_sep: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    if not skip:
        return reader.text(path)
    # A text file's first lines stand where its rows begin in file order; a split that isn't the first has none of them.
    read = reader.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    first = read.where("b = 0").groupBy("f").agg(F.min("i").alias("start"))
    return read.join(F.broadcast(first), "f", "left").where(f"b > 0 OR i >= start + {int(skip)}").select("value")


def wrap_dataset(
    spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", nulls: tuple[str, ...] = NULLS, skip: int = 0, header: bool = False,
    line_filter: Callable[[Column], Column] | None = None, mapper: Callable[[Column], Column] | None = None, line_sep: str | None = None,
) -> Dataset:
    """A view of delimited text with a declared schema; nothing is copied.

    ``separator``: a regular expression. ``skip``: lines left out at the start of
    each file, one more with ``header``. ``line_filter``: condition on the raw
    line. ``mapper``: the array of cells (nulls set) to another one. Quotes are
    part of a cell.
    """
    lines = _lines(spark, path, skip + bool(header), line_sep)
    if line_filter:
        lines = lines.where(line_filter(F.col("value")))
    # White space and control characters at both ends go, but spaces alone where a tab may part cells.
    ends = " " if re.search(separator, "\t") else r"\x00-\x20"
    line = F.regexp_replace("value", f"^[{ends}]+|[{ends}]+$", "")
    cells = F.transform(F.split(line, separator), lambda c: null_if_token(c, nulls))
    if mapper:
        cells = mapper(cells)
    cut = lines.select(cells.alias("cells"))
    made = [parse_datum(F.get("cells", F.lit(i)), kind_of(f)).alias(f.name, metadata=f.metadata) for i, f in enumerate(schema.fields)]
    return Dataset(cut.select(*made))


def import_dataset(spark: SparkSession, source: str, path: str, schema: T.StructType, delim: str = ",", **options) -> Dataset:
    """Copy delimited text into a typed Parquet table and open it; options as of ``wrap_dataset``."""
    return write_table(wrap_dataset(spark, source, schema, delim, **options), path)


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    """A written table with its schema, kinds and date formats."""
    return Dataset(spark.read.parquet(path), path)


def write_table(table: Dataset, path: str | None = None) -> Dataset:
    """Write to ``path`` (or the table's own), replacing what is there."""
    path = path or table.path
    if not path:
        raise ValueError("the table has no path of its own")
    table.df.write.mode("overwrite").parquet(path)
    return open_dataset(table.df.sparkSession, path)


def write_value(spark: SparkSession, path: str, value: object, name: str = "value") -> None:
    """A single value as a table of one row."""
    spark.createDataFrame([(value,)], [name]).write.mode("overwrite").parquet(path)


def read_value(spark: SparkSession, path: str) -> object:
    return spark.read.parquet(path).first()[0]


def combine(spark: SparkSession, table: Table, path: str) -> Dataset:
    """One file of all rows, for results that fit one."""
    as_df(spark, table).coalesce(1).write.mode("overwrite").parquet(path)
    return open_dataset(spark, path)


def read_vectors(df: DataFrame, schema: T.StructType, vector: str = "point") -> DataFrame:
    """An array column, or a struct of a weight and such a ``vector``, as typed columns, in full width; date-times stay milliseconds."""
    if isinstance(df.schema[vector].dataType, T.StructType):
        df = df.select(F.col(f"{vector}.vector").alias(vector))
    made = []
    for i, f in enumerate(schema.fields):
        t = T.DoubleType() if isinstance(f.dataType, T.StringType) else f.dataType
        made.append(F.get(vector, F.lit(i)).try_cast(t).alias(f.name, metadata=f.metadata))
    return df.select(*made)


def read_stf(spark: SparkSession, path: str) -> Dataset:
    """Simple table format: comments (#), the number of columns, a line "name type" each, then rows cut at white space.

    Types: Integer, Real, String. Text that is no number counts as 0 in numeric
    columns. Strings stay columns. The head is what stands first in each file,
    whatever rows look like; all files of a folder have the same one.
    """
    plain = "trim(value) <> '' AND NOT startswith(trim(value), '#')"
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).where(plain)
    # Heads stand in the first split of a file: its least numbers.
    first = read.where("b = 0").groupBy("f").agg(F.min("i").alias("start")).orderBy("f").first()
    line = read.where((F.col("b") == 0) & (F.col("f") == first["f"])).orderBy("i").select("value") if first else None
    head = line.first()[0] if first else ""
    if not re.fullmatch(r"\s*\d+\s*", head):
        raise ValueError(f"{path} does not begin with the number of columns")
    n = int(head)
    top = [r[0].split() for r in line.take(n + 1)[1:]]
    if len(top) < n or any(not t for t in top):
        raise ValueError(f"{path} names fewer than {n} columns")
    names, kinds = [t[0] for t in top], [t[1].lower() if len(t) > 1 else "real" for t in top]
    place = F.row_number().over(Window.partitionBy("f").orderBy("i"))  # of one split of each file
    rows = read.where("b = 0").withColumn("place", place).where(F.col("place") > n + 1).select("value").union(read.where("b > 0").select("value"))
    cells = rows.select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("cells"))
    number = lambda i: F.coalesce(F.get("cells", F.lit(i)).try_cast("double"), F.lit(0.0))
    made = [(F.get("cells", F.lit(i)) if k == "string" else number(i)).alias(name) for i, (name, k) in enumerate(zip(names, kinds, strict=True))]
    return Dataset(cells.select(*made))


def write_brush(brush: DataFrame, path: str, name: str = "brush", weight: str = "weight", row_id: str = "row_id") -> None:
    """A brush as text: a folder with the lines "name" and the number of rows in ``head``, and a line "row weight" each in ``weights``."""
    spark = brush.sparkSession
    brush.select(F.concat_ws(" ", F.col(row_id).cast("string"), F.col(weight).cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/weights")
    spark.createDataFrame([(f"{name}\n{brush.count()}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def read_brush(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The name of a written brush, and (row_id, weight); another number of rows than its head says is an error."""
    name, n = [r[0] for r in spark.read.text(f"{path}/head").collect()]  # two lines
    cells = F.split("value", " ")
    rows = spark.read.text(f"{path}/weights").select(cells[0].cast("long").alias("row_id"), cells[1].cast("double").alias("weight"))
    if rows.count() != int(n):
        raise ValueError(f"{path} says {n} rows and has {rows.count()}")
    return name, rows


def open_last_clusters(spark: SparkSession, path: str) -> DataFrame:
    """The clusters of a stored clustering: those in the folder clusters-N (or clusters-N-final) with the greatest N."""
    found = [(int(m[1]), p) for p in files.ls(spark, path) if (m := re.search(r"clusters-(\d+)(?:-final)?/*$", p))]
    if not found:
        raise ValueError(f"{path} holds no folder clusters-N")
    return spark.read.parquet(max(found)[1])


def write_pairs(df: DataFrame, path: str) -> None:
    """The first two columns as keys and values of a Hadoop sequence file."""
    key, value = df.columns[:2]
    files.delete(df.sparkSession, path)
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path)  # rows themselves have no Java form


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sequence file's pairs, read lazily; ``schema`` names and types key and value."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
