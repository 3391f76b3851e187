"""The package on the executors' Python path, wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import codexmill

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the application's workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(codexmill.__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="codexmill-ship-"))
    shutil.copytree(root, at / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(at / "codexmill"), "zip", at / "tree"))
    shutil.rmtree(at / "tree")
    _shipped.add(context.applicationId)
