"""Global orders without a task that sees all rows: ranges are sorted apart and joined by their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import spool


def in_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and stored, with the number of its range in ``_range``.

    Rows of equal order keys are in one range; ranges follow each other in the order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spool(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), label)


def global_rank(df: DataFrame, order: list[Column], name: str, label: str = "ranked") -> DataFrame:
    """Add ``name``: the place of a row from 1 in the whole order (ties in any order of their own).

    The only window without a partition runs over one row a range.
    """
    ranged = in_ranges(df, order, label)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(before, "_range").select(*df.columns, (F.col("_place") + F.col("_before")).cast("bigint").alias(name))
