"""Tables that cut a lineage: written once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of an execution go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def session_folder(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``, which goes when the driver ends; that setting is made only where it is unset, and only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):  # executors would not see each other's files
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/quirespark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    key = f"{spark.sparkContext.applicationId} {base}"
    if key not in _folders:
        jvm, context = spark.sparkContext._jvm, spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/quirespark-{uuid.uuid4().hex}")
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _folders[key] = store.makeQualified(path).toString().rstrip("/")  # workers don't know the default store
    return _folders[key]


def shared_folder(spark: SparkSession) -> str:
    """A new folder, which all executors see."""
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recorded():
    """The folders that are made inside, as a list."""
    _scopes.append([])
    own = _scopes[-1]
    try:
        yield own
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not own]


@contextmanager
def scratch(spark: SparkSession):
    """Folders that are made inside go at the end, but for those that are taken off the list."""
    with recorded() as own:
        try:
            yield own
        finally:
            deleted(spark, own)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges, on executors alone.

    Spark takes a stored table for as large as its files: lists that are alike on every page have a hundredth of their size there, and would be
    gathered whole by the driver, to be broadcast.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a lost executor loses nothing.

    The shuffle files that led to it go once it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, was = shared_folder(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
