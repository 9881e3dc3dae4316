"""Session factory and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI casts off (scorers rely on null for bad casts) and AQE on.

    Shuffle partitions are left to the caller or the cluster: AQE coalesces what is too many.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables (a file or a directory each)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
