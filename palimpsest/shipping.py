"""Give executors this package, however the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's code to the Python workers, once per Spark context.

    Workers import functions by name; where the package is on the driver's path
    only, they could not.  The archive goes through Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_palimpsest_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("palimpsest", os.path.relpath(path, here)))
    context.addPyFile(archive)
    context._palimpsest_sent = True
