"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet to the folder named in ``spark.checkpoint.dir``: the files outlive any executor,
keep their columns prunable and are compressed. Only where the setting is absent (tests, a laptop) one is made.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only if the session names none (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/pairloom/{label}-{uuid.uuid4().hex}"


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one job, no lineage left."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def forget(*stored: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in stored:
        discard(df.sparkSession, df._scratch_path)


def release(spark: SparkSession) -> None:
    """Between the steps of a long loop: let go of finished plans, their compiled code and their shuffle files.

    Spark deletes shuffle files only once the driver's JVM has collected the plans that own them, and the plans live as
    long as Python's references to them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file of the shared folder, in place of what was there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of :func:`write_text`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    source = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def sweep(spark: SparkSession) -> None:
    """Delete everything that this library has put into the shared folder: for the end of a session, once its results
    are written, as results may read from there."""
    discard(spark, f"{shared_dir(spark)}/pairloom/")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; only paths under the shared folder's own subfolder are accepted."""
    if not path.startswith(f"{shared_dir(spark)}/pairloom/"):
        raise ValueError(f"not a scratch path: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
