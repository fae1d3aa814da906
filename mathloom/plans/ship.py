"""Python code for the executors: the package goes along as a zip, wherever it is installed on the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_mathloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="mathloom-"), "mathloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_ROOT):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("mathloom", os.path.relpath(full, _ROOT)))
    sc.addPyFile(path)
    sc._mathloom_shipped = True
