"""A session tuned for wide feature plans. Settings given by the cluster always win."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A wide bundle compiles a few hundred small classes per query; the default cache of
# 100 would recompile them for every query. Call-site capture costs about half of the
# time it takes to state a bundle of 150 columns.
SETTINGS = {
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus="*", memory="16g", **extra) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("barloom")
    partitions = "8" if cpus == "*" else str(cpus)
    local = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": partitions,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for name, value in {**SETTINGS, **local, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
