"""Session factory for local work; on a cluster the platform's own session serves."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | None = None, name: str = "lodestone") -> SparkSession:
    """A session with adaptive execution, UTC and as many shuffle partitions as cores."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
