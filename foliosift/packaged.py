"""The package as executors get it."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per context: they need not have it installed. Threads
    that ask at the same time wait for the one that does it."""
    with _lock:
        _shipped(spark)


def _shipped(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_foliosift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='foliosift-')}/foliosift.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    context._foliosift_shipped = True
