"""A session with the settings the plans count on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution turns a join into a broadcast when a side proves small, splits hot
# join keys (also when that costs an extra shuffle) and merges small shuffle partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles a method over 8000 bytes; beyond that Spark should split the stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", name: str = "larder") -> SparkSession:
    """For tests and benchmarks; on a cluster pass ``SETTINGS`` to spark-submit."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
               .config("spark.driver.memory", os.environ.get("LARDER_DRIVER_MEMORY", "8g"))
               .config("spark.sql.shuffle.partitions", "8"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
