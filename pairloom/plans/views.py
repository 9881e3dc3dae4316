"""Engine tables derived from stored tables: what the operators call samples, calls, examples and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.pairing import latest
from pairloom.session import table


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Score rows, one a sample: reg_id, prompt_id, example_id, evaluator_name, kind, scores, delta, explanation, error."""
    rows = table(spark, folder, "top_regressions").where("prompt_id is not null and evaluator_name is not null")
    unscored = F.col("delta").isNull() | F.isnan("delta")
    return rows.select(
        "reg_id", "prompt_id", "example_id", "evaluator_name", F.coalesce("kind", F.lit("")).alias("kind"), "source_score", "target_score",
        F.when(~unscored, F.col("delta") + F.lit(0.0)).alias("delta"), "explanation", F.when(unscored, F.lit("unscored")).alias("error"),
    )


def calls(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Model calls with the key and ``columns`` (all if none), each key once (a row appended twice counts once).

    Columns are named here, before the aggregation by key packs them, so that only they are read.
    """
    key = ["run_id", "prompt_id", "example_id", "role", "sample_index"]
    rows = table(spark, folder, "raw_calls")
    if columns:
        rows = rows.select(*key, *[c for c in dict.fromkeys([*columns, "cached_rounds", "latency_ms"]) if c not in key])
    # Both roles of a key are sent to one place, so removing repeats and pairing share the exchange.
    return latest(rows.repartition(*[k for k in key if k != "role"]), key, ["cached_rounds", "latency_ms"])


def examples(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Suite examples with id and ``columns`` (all if none): of rows with one id the first."""
    rows = table(spark, folder, "golden").where("id is not null")
    if columns:
        rows = rows.select("id", "row_id", *columns)
    return latest(rows, ["id"], ["row_id"], first=True)


def capture_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Captures with what was requested and executed: row_id, capture_id, requested, executed (arrays of name, arguments, call_id, q)."""
    rows = table(spark, folder, "multi_round_tools")
    e = "trace.events"
    zipped = F.arrays_zip(*[F.col(f"{e}.{n}").alias(n) for n in ("type", "sequence_index", "name", "arguments", "call_id", "requested_tool_calls")])
    ordered = F.array_sort(F.transform(F.filter(zipped, lambda x: x["type"].isin("model_call", "tool_call")), lambda x: F.struct(x["sequence_index"].alias("q"), x["type"].alias("type"), x["name"].alias("name"), x["arguments"].alias("arguments"), x["call_id"].alias("call_id"), x["requested_tool_calls"].alias("asked"))))
    executed = F.transform(F.filter("ordered", lambda x: x["type"] == "tool_call"), lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("arguments"), x["call_id"].alias("call_id"), x["q"].alias("q")))
    asked = F.flatten(F.transform(F.filter("ordered", lambda x: (x["type"] == "model_call") & x["asked"].isNotNull()), lambda x: F.transform(x["asked"], lambda a: F.struct(a["name"].alias("name"), a["arguments"].alias("arguments"), a["call_id"].alias("call_id"), x["q"].alias("q")))))
    return rows.select("row_id", "capture_id", ordered.alias("ordered")).select("row_id", "capture_id", asked.alias("requested"), executed.alias("executed"))
