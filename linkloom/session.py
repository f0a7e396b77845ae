"""Session settings the library is meant to run with."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from linkloom.streaming.frontier import RECOMMENDED as STREAMING

#: settings that only a session's builder can make: capturing the call site of
#: every Column operation costs more than planning the queries
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    **STREAMING,
}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors (once), for Arrow functions and sources."""
    context = spark.sparkContext
    if getattr(context, "_linkloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="linkloom-"), "linkloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._linkloom_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and ship the package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark
