"""Session builder: ANSI, AQE, UTC; partitions are left to AQE and the size of the data."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName("lodestar")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
