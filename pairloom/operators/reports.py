"""Rollups and rankings of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by ``keys`` in which nulls meet."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def role_economics(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per role: calls, failures, replays, cost and tokens, mean and p95 of live error-free latency.

    The p95 is the value at place max(1, round half even of 0.95 n), counted from the sorted distinct latencies with
    their counts, so that no role's latencies are gathered. A latency below zero is "not measured".
    """
    live = F.col("error").isNull() & ~F.coalesce("cached", F.lit(False)) & (F.col("latency_ms") >= 0)
    keys = [*by, "role"]
    cost = F.when(F.isnan("cost_usd"), None).otherwise(F.col("cost_usd"))
    totals = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count("error").alias("failed"), F.count_if("cached").alias("cached"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.avg(F.when(live, F.col("latency_ms"))).alias("latency_mean"),
    )
    steps = calls.where(live).groupBy(*keys, "latency_ms").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy("latency_ms")
    placed = steps.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    rank = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(95) / F.lit(100)))
    p95 = placed.where(F.col("upto") >= rank).groupBy(*keys).agg(F.min("latency_ms").alias("latency_p95"))
    return null_safe_left(totals, p95, keys)


def nearest_rank(calls: DataFrame, value: Column, by: list[str], per_cent: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles (place ceil(p n)) from distinct values with their counts."""
    steps = calls.select(*by, value.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c"))
    order, whole = Window.partitionBy(*by).orderBy("v"), Window.partitionBy(*by)
    placed = steps.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(whole))
    at = {name: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.expr(f"(n * {p} + 99) div 100")), F.col("v"))) for name, p in per_cent.items()}
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *[x.alias(name) for name, x in at.items()])


def medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median of every group (mean of the two middle values) from distinct values with their counts: by, median."""
    steps = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    order, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    placed = steps.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(whole))
    at = lambda rank: F.min(F.when(F.col("upto") >= F.expr(rank), F.col(value)))
    return placed.groupBy(*by).agg(((at("(n + 1) div 2") + at("(n + 2) div 2")) / 2).alias("median"))


def relative_increase(calls: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Mean of the target over that of the source, less 1 and floored at 0, over error-free calls; ``measured`` is false
    when a side has no value or both means are 0. A source mean of 0 gives 1 if the target has any, else 0."""
    ok = F.col("error").isNull()
    means = calls.groupBy(*by).agg(*[F.avg(F.when(ok & (F.col("role") == r), value)).alias(r) for r in ("source", "target")])
    s, t = F.coalesce("source", F.lit(0.0)), F.coalesce("target", F.lit(0.0))
    increase = F.when(s > 0, F.greatest(F.lit(0.0), t / s - 1)).otherwise(F.when(t > 0, 1.0).otherwise(0.0))
    return means.select(*by, increase.alias("increase"), (F.col("source").isNotNull() & F.col("target").isNotNull() & ((s != 0) | (t != 0))).alias("measured"))


def worst_rows(scores: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The k smallest deltas of each group, and of those only the regressions: fewer than k may remain."""
    w = Window.partitionBy(*by).orderBy("delta", *order)
    return scores.where("delta is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where("delta < 0 and error is null")


def example_pass(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per example: passed (no error and no negative delta), worst delta, scores."""
    return scores.groupBy(*by).agg(F.count("*").alias("scores"), F.bool_and(F.col("error").isNull() & (F.col("delta") >= 0)).alias("passed"), F.min("delta").alias("worst"))


def pass_rates(passes: DataFrame, by: list[str]) -> DataFrame:
    """Total, passed and pass rate."""
    return passes.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("pass_rate", F.col("passed") / F.col("total"))


def score_rates(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rates over the evidence (rows without error, less ground-truth misses shared by both sides): n, improved,
    equivalent and regressed."""
    shared = (F.col("delta") == 0) & (F.col("kind") == "tool_selection.conformance") & (F.col("source_score") < 1) & (F.col("target_score") < 1)
    e = scores.where(F.col("error").isNull() & ~F.coalesce(shared, F.lit(False)))
    return e.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") == 0).alias("equivalent"), F.count_if(F.col("delta") < 0).alias("regressed"))


def category_counts(rows: DataFrame, categories: Column) -> DataFrame:
    """Counts of labels held in arrays, most common first by ``place``."""
    counts = rows.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


def positional_diff(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Differences of two call sequences by position: key, position, source, target, change.

    ``pairs`` has arrays of structs (name, arguments) ``requested`` and ``executed``. Both are unrolled in one
    explode, so there is no join.
    """
    # Zipping pads the shorter side with nulls.
    both = pairs.select(*key, F.posexplode(F.arrays_zip("requested", "executed")).alias("position", "z"))
    s, t = F.col("z.requested"), F.col("z.executed")
    change = (
        F.when(t.isNull(), "missing")
        .when(s.isNull(), "extra")
        .when(~s["name"].eqNullSafe(t["name"]), "selection")
        .when(~s["arguments"].eqNullSafe(t["arguments"]), "arguments")
    )
    return both.select(*key, "position", s["name"].alias("source"), t["name"].alias("target"), change.alias("change")).where("change is not null")
