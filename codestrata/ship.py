"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's modules to the session's workers, once a context.

    The archive is read by the driver's file server only; executors fetch it."""
    context = spark.sparkContext
    if getattr(context, "_codestrata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="codestrata-"), "codestrata_modules.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("codestrata", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._codestrata_shipped = True
