"""A session with the settings that the library is tested with; any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tallow").config("spark.sql.shuffle.partitions", partitions)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
