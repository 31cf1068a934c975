"""Takes the package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tabularium

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session, once. To be called before a function of the package is given to Spark."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(tabularium.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tabularium-modules.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("tabularium", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
