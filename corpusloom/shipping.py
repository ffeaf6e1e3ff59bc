"""Sends this package to the executors, so that Python kernels import there whatever their path is."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_sent: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once per Spark context."""
    context = spark.sparkContext
    if context in _sent:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "corpusloom_shipped.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context)


def shipped(fn):
    """fn(spark, ...) that ships the package first."""

    @wraps(fn)
    def run(spark, *args, **kwargs):
        ship(spark)
        return fn(spark, *args, **kwargs)

    return run
