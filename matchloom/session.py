"""Session defaults for local use; a cluster brings its own configuration."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "matchloom", **conf: str) -> SparkSession:
    """A local session with AQE, UTC and few shuffle partitions; ``conf`` overrides (dots as ``__``)."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("MATCHLOOM_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
        "spark.executorEnv.PYTHONPATH": str(Path(__file__).resolve().parents[1]),  # Python workers import this package
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
