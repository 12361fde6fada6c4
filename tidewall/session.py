"""Session defaults shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidewall", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC, ANSI and AQE on; a cluster brings its own master and sizes."""
    cores = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if "SPARK_REMOTE" not in os.environ and not os.environ.get("MASTER"):
        builder = builder.master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
