"""Intermediate tables in the folder that all executors share.

A plan whose lineage must be cut (a result that several branches read, or a loop) is written as
Parquet below ``spark.checkpoint.dir`` and read back, so a lost executor costs nothing but its
running tasks. A session without that setting gets a folder of this machine if it runs on this
machine only, as in tests, and is refused otherwise.

Tables are removed by :func:`discard` once what they were made for is written, at the end of a
:func:`scope`, or when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []
_alive: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local session that names none gets a temporary one, once."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="codexmill-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def temporary_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed at the end of the scope, or when Python ends."""
    path = f"{shared_dir(spark)}/codexmill-{label}-{uuid.uuid4().hex}"
    if not _alive:
        atexit.register(_remove_all, spark)
    _alive.add(path)
    for made in _scopes[-1:]:
        made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = temporary_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more. Other tables stay as they are."""
    for t in tables:
        if path := _paths.pop(t, None):
            _remove(t.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at the end: results must be stored or collected before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _alive:
        _alive.discard(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all(spark: SparkSession) -> None:
    for path in list(_alive):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _remove(spark, path)
