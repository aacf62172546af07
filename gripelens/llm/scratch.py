"""Settings for operators that write many intermediate tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


def free_finished_shuffles(spark: SparkSession) -> None:
    """Delete shuffle files when the query that wrote them has ended.

    Every intermediate table is written once and read from there, so no finished
    query's shuffle is needed again; without this they stay until the driver
    happens to collect its garbage.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
