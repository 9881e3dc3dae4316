"""Calls, pairs and work lists: what was run, what belongs together, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL_KEY = ["run_id", "prompt_id", "example_id", "sample_index"]


def latest(df: DataFrame, key: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row a key: the last (or first) by ``order``; rows meet within tasks before they are exchanged, and only rows
    of one key are compared, never sorted by ``order``. Null keys are a key."""
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by if first else F.max_by
    rank = F.struct(*[F.col(c).isNotNull() for c in order], *[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in rest]))
    return df.groupBy(*key).agg(pick(F.struct(*rest), rank).alias("_r")).select(*key, "_r.*")


def pair_roles(calls: DataFrame, key: list[str] = CALL_KEY) -> DataFrame:
    """Source and target call of every key that has both: key, source, target (structs of the other columns).

    Both roles meet in one aggregation by key, not in a self-join; a key with one role gives no row. Calls must be
    unique by key and role (see :func:`latest`); keys with a null part pair like any other.
    """
    rest = F.struct(*[c for c in calls.columns if c not in {*key, "role"}])
    roles = [F.first(F.when(F.col("role") == r, rest), ignorenulls=True).alias(r) for r in ("source", "target")]
    return calls.where(F.col("role").isin("source", "target")).groupBy(*key).agg(*roles).where("source is not null and target is not null")


def with_examples(pairs: DataFrame, examples: DataFrame) -> DataFrame:
    """Pairs with their suite example; a pair of an unknown example stays, with ``known`` false and null fields."""
    fields = F.struct(*[c for c in examples.columns if c != "id"])
    return pairs.join(examples.select(F.col("id").alias("example_id"), fields.alias("example")), "example_id", "left").withColumn("known", F.col("example").isNotNull())


def representative(calls: DataFrame) -> DataFrame:
    """Calls of sample 0."""
    return calls.where("sample_index = 0")


def call_flags(calls: DataFrame) -> DataFrame:
    """Add succeeded, truncated, replayed and empty; a null finish reason is neither truncated nor empty."""
    finish = F.coalesce("finish_reason", F.lit(""))
    return calls.withColumns({
        "succeeded": F.col("error").isNull(),
        "truncated": finish == "length",
        "replayed": F.coalesce(F.col("cached_rounds") > 0, F.lit(False)) | F.coalesce("cached", F.lit(False)),
        "empty": F.coalesce((F.col("text") == "") & (F.col("output_tokens") > 0), F.lit(False)) & F.col("error").isNull() & (finish == "stop"),
    })


def work_list(prompts: DataFrame, examples: DataFrame, samples: int) -> DataFrame:
    """prompt_id, example_id, sample_index, role: everything a run has to call.

    The product is what the operator is for; its size is the run's size. Prompts are a configuration table, so the
    optimiser broadcasts them when their measured size allows and loops over partitions otherwise.
    """
    pairs = prompts.select("prompt_id").distinct().join(examples.select(F.col("id").alias("example_id")))
    return pairs.select("prompt_id", "example_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index")).select("*", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("role"))


def pending(work: DataFrame, calls: DataFrame) -> DataFrame:
    """Work without a call yet (a failed call counts as done)."""
    key = ["prompt_id", "example_id", "sample_index", "role"]
    return work.join(calls.select(*key).distinct(), key, "left_anti")


def role_coverage(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key which roles exist: key, has_source, has_target."""
    return rows.groupBy(*key).agg(F.bool_or(F.col("role") == "source").alias("has_source"), F.bool_or(F.col("role") == "target").alias("has_target"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


# Response shapes and what in a model id tells them, in order. Slashed prefixes are matched as written,
# the rest in lower case.
PROVIDERS = [("anthropic", ["anthropic/"], [], ["claude"]), ("openai", ["openai/"], ["gpt-", "o1-", "o3-"], []), ("gemini", ["gemini/"], [], ["gemini"]), ("openai", [], [], ["deepseek"])]


def detect_provider(model: Column) -> Column:
    """Response shape of a model id, the first rule that matches; null if none does (see :func:`provider_error`)."""
    low = F.lower(model)
    out = F.lit(None).cast("string")
    for name, written, starts, parts in reversed(PROVIDERS):
        tests = [*(model.startswith(x) for x in written), *(low.startswith(x) for x in starts), *(low.contains(x) for x in parts)]
        hit = tests[0]
        for test in tests[1:]:
            hit = hit | test
        out = F.when(hit, name).otherwise(out)
    return out


def provider_error(model: Column) -> Column:
    """The error of a model id that no rule knows; null for known ones. A null id is unknown too."""
    return F.when(detect_provider(model).isNull(), F.concat(F.lit("cannot detect provider for model id: "), F.coalesce(model, F.lit("null"))))
