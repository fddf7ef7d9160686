"""Sending this library to the executors, for clusters on which it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the library's sources to the application's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    home = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="accordant-"), "accordant.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(target)
    _sent.add(context.applicationId)
