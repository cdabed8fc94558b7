"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_clickloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="clickloom-zip-")
    archive = shutil.make_archive(
        os.path.join(folder, "clickloom"), "zip", os.path.dirname(_PACKAGE), os.path.basename(_PACKAGE)
    )
    sc.addPyFile(archive)  # Spark serves the archive to every executor
    sc._clickloom_shipped = True
