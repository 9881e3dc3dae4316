"""Incremental ingestion of call logs and captures with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.sources.jsonl import CALL

CALL_KEY = ["prompt_id", "example_id", "role", "sample_index"]


def call_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON line files of a folder as a stream of calls; cut-off lines are left out."""
    schema = T.StructType.fromDDL(CALL)
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once_per_key(calls: DataFrame, time: str, late: str) -> DataFrame:
    """The first call of every key; state older than the allowed lateness is dropped, so it stays bounded."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(CALL_KEY)


def progress(calls: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Calls, failures and cost of every time window and role, complete once the watermark has passed."""
    return (
        calls.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), "role")
        .agg(F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum("cost_usd").alias("cost"))
        .select("w.start", "role", "calls", "failed", "cost")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is there now and stop; a second run resumes from the checkpoint and writes nothing twice."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sync_new(stream: DataFrame, target: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows whose key the target does not hold; a batch that is replayed after a failure adds nothing.

    Each batch is written to a folder named by its number, so a repeated batch replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fresh = batch.dropDuplicates(key)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(target).where(F.col("batch") != number)
            fresh = fresh.join(held.select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
