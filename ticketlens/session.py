"""Session settings used by the tests and the bench; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: The JVM leaves longer methods uncompiled; Spark then splits the code of a row into shorter ones.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def split_long_methods(spark: SparkSession) -> None:
    """Sets ``METHOD_LIMIT`` in a session that states no limit of its own."""
    name, limit = METHOD_LIMIT
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, limit)


def local_session(
    cores: int | str = 8, memory: str = "8g", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """``shared`` is the folder for intermediate tables, as spark.checkpoint.dir is on a cluster."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ticketlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
