"""Where tables that cut lineage, and other files that all executors must see, are written."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one under the warehouse where it names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    java = spark.sparkContext._jsc.sc().getCheckpointDir()
    if java.isDefined():
        return java.get()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
