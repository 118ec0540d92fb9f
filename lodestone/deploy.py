"""Sends the package to the executors of a cluster on which it isn't installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Zips the package on the driver and gives it to Spark, which copies it to every worker; returns the archive's path.

    Workers need it for the operators that run Python. Call it once for a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lodestone"), "zip", root, "lodestone")
    spark.sparkContext.addPyFile(archive)
    return archive
