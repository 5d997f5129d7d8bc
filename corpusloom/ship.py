"""The package on the executors' path, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules along with the session's tasks, once per application.

    Spark serves the archive from the driver to every executor, so nobody has to
    install the package on the machines.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom_modules.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in sorted(os.walk(package)):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
