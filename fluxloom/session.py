"""A local session for development; on a cluster the launcher's settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int = 8, name: str = "fluxloom") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
