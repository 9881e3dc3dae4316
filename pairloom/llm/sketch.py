"""Percentiles of very large columns from mergeable bucket counts.

A value falls into a signed logarithmic bucket: bucket i of a sign holds the magnitudes in (g^(i-1), g^i] with
g = (1 + a) / (1 - a); zero has a bucket of its own. The bucket's middle 2 g^i / (1 + g) is within the relative error
``a`` of every value in it, so a percentile read from the counts is within ``a`` of the exact nearest-rank percentile.
Counts of partitions, days or runs add up bucket by bucket; adding them loses nothing.

Defined results: null and NaN are left out; infinities have the outermost bucket; a group without values has no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.01
#: Partial sketches a run and prompt, so that a huge one is spread over as many tasks.
PARTS = 16


def growth(error: float = RELATIVE_ERROR) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error must be between 0 and 1")
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = RELATIVE_ERROR) -> tuple[Column, Column]:
    """(sign, bucket) of a value; the sign is -1, 0 or 1 and the bucket 0 for zero."""
    size = F.least(F.abs(value), F.lit(1.7e308))
    bucket = F.ceil(F.log(size) / F.lit(math.log(growth(error)))).cast("int")
    return F.signum(value).cast("int"), F.when(value == 0, F.lit(0)).otherwise(bucket)


def middle_of(sign: Column, bucket: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value that stands for a bucket."""
    g = growth(error)
    return sign * F.lit(2 / (1 + g)) * F.exp(bucket * F.lit(math.log(g)))


def sketch(df: DataFrame, keys: list[str], value: str, error: float = RELATIVE_ERROR) -> DataFrame:
    """Bucket counts: keys, sign, bucket, n. Pre-aggregated before the shuffle, so a huge key is no hot spot."""
    sign, bucket = bucket_of(F.col(value), error)
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    return kept.groupBy(*keys, sign.alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Add the counts of matching buckets; ``keys`` is what stays apart."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], per_mille: dict[str, int], error: float = RELATIVE_ERROR) -> DataFrame:
    """Nearest-rank percentiles of merged sketches: keys, n and one column an entry of ``per_mille``.

    The rank is max(1, ceil(q n)), in integers. A key's rows here are its buckets, whose number is bounded by the
    range of doubles (at one per cent about 71,000 a sign), never by its values.
    """
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    running = sketches.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    out = [F.max("_all").alias("n")]
    for name, q in per_mille.items():
        rank = F.greatest(F.lit(1), F.expr(f"(_all * {q} + 999) div 1000"))
        at = F.when(F.col("_upto") >= rank, F.struct("_upto", middle_of(F.col("sign"), F.col("bucket"), error).alias("v")))
        out.append(F.min(at)["v"].alias(name))
    return running.groupBy(*keys).agg(*out)


def call_sketches(calls: DataFrame, error: float = RELATIVE_ERROR) -> DataFrame:
    """Partial sketches a run: run_id, prompt_id, part, metric, sign, bucket, n.

    The one exchange, by run, prompt and part, serves the removal of repeats and the counting alike. A call appended twice (same run, prompt, example, role and sample) counts once. A latency below zero means "not
    measured" and is left out; costs of zero count.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("example_id", "role", "sample_index")]
    once = (
        calls.select("run_id", "prompt_id", F.xxhash64(F.lit(1), *key).alias("_a"), F.xxhash64(F.lit(2), *reversed(key)).alias("_b"), "latency_ms", "cost_usd")
        .withColumn("part", F.pmod("_a", F.lit(PARTS)).cast("int"))
        .repartition("run_id", "prompt_id", "part")
        .groupBy("run_id", "prompt_id", "part", "_a", "_b")
        .agg(F.max("latency_ms").alias("latency_ms"), F.min("cost_usd").alias("cost_usd"))
    )
    latency = F.when(F.col("latency_ms") >= 0, F.col("latency_ms").cast("double"))
    metrics = F.array(F.struct(F.lit("latency_ms").alias("metric"), latency.alias("value")), F.struct(F.lit("cost_usd").alias("metric"), F.col("cost_usd").alias("value")))
    return sketch(once.select("run_id", "prompt_id", "part", F.inline(metrics)), ["run_id", "prompt_id", "part", "metric"], "value", error)
