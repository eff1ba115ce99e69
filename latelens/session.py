"""Session settings the jobs expect.

On a cluster the session comes from the launcher; ``SETTINGS`` lists what should be
set there.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps are naive; one fixed zone keeps day and month borders stable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Run-time re-planning: coalescing, size-checked broadcast, skewed-join splitting.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "12g", name: str = "latelens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_fixed_zone(spark: SparkSession) -> None:
    """Pin the run-time zone on a session that somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
