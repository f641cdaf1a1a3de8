"""Sessions for tests, the bench and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the library counts on, whatever the cluster sets besides.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster use the session that is there."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessaline")
    builder = builder.config(map=SETTINGS).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
