"""A keyed cache of results: latest entry by key, with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_DAYS = 7


def latest_entries(entries: DataFrame) -> DataFrame:
    """The last entry of every cache_key by created_at; later files win ties by value."""
    rest = [c for c in entries.columns if c != "cache_key"]
    return entries.groupBy("cache_key").agg(F.max_by(F.struct(*rest), F.struct("created_at", F.xxhash64(*rest))).alias("e")).select("cache_key", "e.*")


def look_up(requests: DataFrame, entries: DataFrame, now: str, days: int = TTL_DAYS) -> DataFrame:
    """Requests (with cache_key) with their cached fields and ``hit``; entries older than ``days`` at ``now`` miss."""
    live = latest_entries(entries).where(F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
    return requests.join(live.withColumn("hit", F.lit(True)), "cache_key", "left").na.fill(False, ["hit"])


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after an upsert; the later of two entries of a key stays."""
    return latest_entries(entries.unionByName(new))
