"""The session, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("hustings").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once per application, so that tasks can import them anywhere."""
    context = spark.sparkContext
    if not getattr(context, "_hustings_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="hustings-"), "hustings.zip")
        with zipfile.ZipFile(path, "w") as packed:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        packed.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
        context._hustings_shipped = True
    return spark
