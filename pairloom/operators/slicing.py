"""Samples to scores, and scores to overlapping slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_KEY = ["prompt_id", "example_id", "evaluator_name", "kind"]
ALL = "all"


def reduce_samples(samples: DataFrame) -> DataFrame:
    """One score a (prompt, example, evaluator, kind): means over the samples without error, their count and variance.

    If all samples failed the scores are null and ``error`` joins the distinct messages in order.
    """
    ok = F.col("error").isNull()
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return samples.groupBy(*SCORE_KEY).agg(
        F.count("*").alias("samples"),
        F.count_if(ok).alias("scored"),
        mean("source_score").alias("source_score"),
        mean("target_score").alias("target_score"),
        mean("delta").alias("delta"),
        F.coalesce(F.var_samp(F.when(ok, F.col("delta"))), F.lit(0.0)).alias("delta_variance"),
        F.when(F.count_if(ok) == 0, F.array_join(F.array_sort(F.collect_set("error")), "; ")).alias("error"),
    )


def coverage(samples: DataFrame) -> DataFrame:
    """Per evaluator and kind: attempted, recorded and unmeasured cells, counted before anything is exploded."""
    cells = samples.groupBy(*SCORE_KEY).agg(F.bool_or(F.col("error").isNull()).alias("measured"))
    return cells.groupBy("evaluator_name", "kind").agg(F.count("*").alias("attempted"), F.count_if("measured").alias("recorded"), F.count_if(~F.col("measured")).alias("unmeasured"))


def slice_rows(scores: DataFrame, examples: DataFrame) -> DataFrame:
    """Scores by slice: every score is in ``all`` and in each tag of its example; a repeated tag repeats the row.

    An example without tags, or an unknown one, is in ``all`` only.
    """
    tags = examples.select(F.col("id").alias("example_id"), "tags")
    named = F.concat(F.array(F.lit(ALL)), F.coalesce("tags", F.array().cast("array<string>")))
    return scores.join(tags, "example_id", "left").withColumn("slice_name", F.explode(named)).drop("tags")


def unmeasured_by_slice(scores: DataFrame, examples: DataFrame) -> DataFrame:
    """Cells without a score by slice, prompt, evaluator and kind."""
    return slice_rows(scores.where("error is not null"), examples).groupBy("slice_name", "prompt_id", "evaluator_name", "kind").agg(F.count("*").alias("unmeasured"))


def slice_aggregates(rows: DataFrame) -> DataFrame:
    """Per slice: n, mean scores, mean, least and greatest delta, sample deviation (0 for one row)."""
    return rows.where("error is null").groupBy("slice_name").agg(
        F.count("*").alias("n"), F.avg("source_score").alias("source_mean"), F.avg("target_score").alias("target_mean"), F.avg("delta").alias("delta_mean"),
        F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("delta_std"),
    )


def dedupe_slices(rows: DataFrame, preferred: list[str] = (), provenance: str = "captured") -> DataFrame:
    """Slices that hold the same score keys collapse to one: signature, slice_name (kept), collapsed (the others).

    ``all`` and preferred slices are kept first, the provenance tag last, then the alphabet decides. The signature adds
    up two hashes a row, so no slice is gathered; equal signatures with equal counts are equal multisets.
    """
    key = [F.coalesce(F.col(c), F.lit("\0")) for c in ("prompt_id", "evaluator_name", "kind", "example_id")]
    h = F.xxhash64(F.lit(1), *key), F.xxhash64(F.lit(2), *key)
    signed = rows.where("error is null").groupBy("slice_name").agg(F.count("*").alias("n"), *[F.sum(x.cast("decimal(20,0)")).cast("string").alias(f"h{i}") for i, x in enumerate(h)])
    first = F.when(F.col("slice_name") == ALL, 0).when(F.col("slice_name").isin(list(preferred)), 1).when(F.col("slice_name") == provenance, 3).otherwise(2)
    order = Window.partitionBy("n", "h0", "h1").orderBy(first, "slice_name")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return signed.withColumn("rank", F.row_number().over(order)).withColumn("names", F.collect_list("slice_name").over(whole)).where("rank = 1").select("slice_name", "n", F.slice("names", 2, F.size("names")).alias("collapsed"))


def with_tag(examples: DataFrame, tag: str) -> DataFrame:
    """Examples that carry a tag."""
    return examples.where(F.array_contains("tags", tag))
