"""Paths in any file system that Spark reads."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def join(base: str, *more: str) -> str:
    return "/".join([base.rstrip("/"), *[m.strip("/") for m in more]])


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def mkdir(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def ls(spark: SparkSession, path: str, files_only: bool = False) -> list[str]:
    """What stands in a folder, not below it, by name."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if not (files_only and s.isDirectory()))


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all it holds; False if there is none."""
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def show(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    """The first lines of text files."""
    return [r[0] for r in spark.read.text(path).take(lines)]


def use_config(spark: SparkSession, *paths: str) -> None:
    """Add the settings of Hadoop configuration files (XML, on the driver's machine) to those of the session; later ones win. A missing file is an error."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        if not Path(path).is_file():
            raise FileNotFoundError(path)
        conf.addResource(spark._jvm.org.apache.hadoop.fs.Path(Path(path).absolute().as_uri()))
    conf.size()  # the files are read now, so that a broken one is an error here


def bootstrap(spark: SparkSession, *paths: str) -> str:
    """Take over configuration files, if any, and give the address of the file system that paths without one then mean."""
    use_config(spark, *paths)
    return spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getUri().toString()
