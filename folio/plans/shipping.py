"""Makes the package importable in the Python workers of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once an application; executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="folio-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    root = os.path.join(folder, "src")
    shutil.copytree(package, os.path.join(root, "folio"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "folio"), "zip", root))
    _shipped.add(context.applicationId)
