"""Session settings shared by the entry points, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike; nothing here depends on the size of the input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller's own session is used as it is."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more
    builder = SparkSession.builder.master(master).appName("quadrille")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
