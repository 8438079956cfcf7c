"""Gives this package to the executors' Python workers, which need not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Adds an archive of the package to the session's files, once a context."""
    context = spark.sparkContext
    if hasattr(context, "_lumaframe_shipped"):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lumaframe-code-")  # the driver's own, from which it serves the archive as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, f"{folder}/code/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}_code", "zip", f"{folder}/code"))
    context._lumaframe_shipped = True
