"""Tables in the folder that driver and executors share; they cut lineage and outlive an executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that exist, by path.
_kept: dict[str, Stored] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="statweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Stored:
    """A DataFrame written to the shared folder and read again: short lineage that outlives an executor.

    Operators drop their tables, but for those that their (lazy) result still
    reads; ``release`` drops these, as does the end of the process.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/statweave-{uuid.uuid4().hex}"
        _kept[self.path] = self
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        _kept.pop(self.path, None)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage, upon which Spark removes the shuffle files of finished plans; else they stay on executors' disks until the driver's heap happens to fill."""
    spark._jvm.System.gc()


class Scratch(Stored):
    """A path in the shared folder for files of any format, dropped like a stored table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/statweave-{uuid.uuid4().hex}"
        _kept[self.path] = self


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def tables() -> set[str]:
    """The paths of all tables that exist now; given to ``release`` later, they stay."""
    return set(_kept)


def release(but: set[str] = frozenset()) -> None:
    """Drop all tables that results still read, except those in ``but``: call it once the results have been written."""
    for path, table in list(_kept.items()):
        if path not in but:
            table.drop()


@atexit.register
def _at_end() -> None:
    for table in list(_kept.values()):
        with contextlib.suppress(Exception):  # the session may have ended before
            table.drop()
