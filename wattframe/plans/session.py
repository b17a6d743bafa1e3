"""Session defaults shared by tests, the bench and jobs."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "wattframe", **conf: str) -> SparkSession:
    """UTC session with adaptive execution; leaves cluster sizing to the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it by
    name; needed where it is not installed on them.  Nothing to do in local
    mode with the package on the path."""
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="wattframe-package-")  # read by the driver only, which serves it
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
