"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Spark's switch for removing an execution's shuffle files when it is done, on all executors.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Unset, it is a local one for a session on one machine; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "linkspark-shared")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, store = _folder(spark, path)
    store.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `materialize` writes inside goes at the end, so all that reads it must have been written out before."""
    path = f"{_scratch.get() or shared_dir(spark)}/{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, path)


@contextmanager
def _no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go at once, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write(df: DataFrame, keep: bool = False) -> str:
    """Write df as Parquet into the shared folder and return where.  It goes with the session, or with the `scratch` around this (unless keep)."""
    spark = df.sparkSession
    inside = None if keep else _scratch.get()
    path = f"{inside or shared_dir(spark)}/{uuid.uuid4().hex}"
    with _no_shuffles_left(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not inside:
        where, store = _folder(spark, path)
        store.deleteOnExit(where)
    return path


def _read(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def materialize(df: DataFrame) -> DataFrame:
    """df, written and read again, so that lineage ends."""
    return _read(df, write(df))


def drop(*dfs: DataFrame) -> None:
    """Delete what `materialize` wrote for these, once nothing reads it any more; other frames stay."""
    for df in dfs:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written and read again; all that was written on the way goes."""
    outer = _scratch.get()
    with scratch(spark):
        result = make()
        token = _scratch.set(outer)
        try:
            return materialize(result)
        finally:
            _scratch.reset(token)
