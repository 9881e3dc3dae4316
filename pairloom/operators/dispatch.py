"""From pairs of calls to score records: declared evaluators, one record an axis, failures instead of scores.

Evaluators are declared as rows of a small configuration; every pair meets every one of them in one explode, so the
pairs are neither joined nor shuffled for it. A record exists for every axis that measured something or failed; an axis
that measured nothing is a cell without a record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One thing that an evaluator measures: scores of both sides as columns (null: nothing measured)."""

    evaluator: str
    kind: str
    source: Column
    target: Column
    blocking: bool = True
    explanation: str | None = None


RECORD = ["evaluator_name", "kind", "blocking", "source_score", "target_score", "delta", "error", "explanation"]
# The scores of a record that failed.
UNMEASURED = 0.5


def records(pairs: DataFrame, axes: list[Axis], keys: list[str]) -> DataFrame:
    """Cells of all pairs and axes: keys, RECORD columns and ``recorded``.

    ``pairs`` has source and target (structs with error and finish_reason) and what the axes refer to. A pair whose call
    failed gives a failed record an axis, then one that was cut at the token limit does, else the axis' scores count.
    """
    failed = F.array_compact(F.array("source.error", "target.error"))
    cut = (F.coalesce("source.finish_reason", F.lit("")) == "length") | (F.coalesce("target.finish_reason", F.lit("")) == "length")
    error = F.when(F.size(failed) > 0, F.concat(F.lit("upstream call failed: "), F.array_join(failed, "; "))).when(cut, "output truncated (token cap)")
    rows = pairs.withColumn("_error", error)

    def cell(a: Axis) -> Column:
        ok = F.col("_error").isNull()
        s, t = (F.when(ok, c.cast("double")).otherwise(UNMEASURED) for c in (a.source, a.target))
        return F.struct(
            F.lit(a.evaluator).alias("evaluator_name"), F.lit(a.kind).alias("kind"), F.lit(a.blocking).alias("blocking"), s.alias("source_score"), t.alias("target_score"), (t - s).alias("delta"),
            F.col("_error").alias("error"), F.when(ok, F.lit(a.explanation).cast("string")).alias("explanation"), (~ok | (a.source.isNotNull() & a.target.isNotNull())).alias("recorded"),
        )

    return rows.select(*keys, F.inline(F.array(*[cell(a) for a in axes])))


def all_records(*parts: DataFrame) -> DataFrame:
    """Records of call evaluators and of trace evaluators as one table; ``part`` keeps their order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def is_kind(name: Column, kind: Column, wanted: str, legacy: str | None = None) -> Column:
    """Whether a record is of a kind; one without a kind is told by the beginning of its evaluator's name, if that is known."""
    old = name.startswith(legacy) if legacy else F.lit(False)
    return F.when(F.coalesce(kind, F.lit("")) != "", kind == wanted).otherwise(F.coalesce(old, F.lit(False)))


def advisory_names(comparisons: DataFrame, rows: DataFrame) -> DataFrame:
    """Evaluators that gate nothing: evaluator_name. Told by any record or, as silent ones have none, by a comparison's note."""
    noted = comparisons.where(F.exists("notes", lambda n: n.startswith("advisory"))).select("evaluator_name")
    return rows.where("not blocking").select("evaluator_name").unionByName(noted).distinct()


def unmeasured_gates(comparisons: DataFrame, rows: DataFrame) -> DataFrame:
    """Gating evaluators with a comparison, in any slice, that measured nothing: evaluator_name."""
    silent = comparisons.where(F.exists("notes", lambda n: n.startswith("nothing measured:"))).select("evaluator_name").distinct()
    return silent.join(advisory_names(comparisons, rows), "evaluator_name", "left_anti")


def shared_misses(comparisons: DataFrame, rows: DataFrame) -> DataFrame:
    """Comparisons with ``shared_miss`` (how many records) where every record behind them is a ground-truth miss of both sides.

    ``comparisons``: prompt_id, evaluator_name, axis (null or a kind) and others. ``rows``: prompt_id, evaluator_name,
    kind, error, miss. Records are counted before they meet the comparisons.
    """
    counts = rows.where("error is null").groupBy("prompt_id", "evaluator_name", "kind").agg(F.count("*").alias("n"), F.count_if("miss").alias("m"))
    whole = counts.groupBy("prompt_id", "evaluator_name").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).withColumn("kind", F.lit(None).cast("string"))
    both = counts.unionByName(whole.select("prompt_id", "evaluator_name", "kind", "n", "m"))
    by = both.withColumnsRenamed({"prompt_id": "_p", "evaluator_name": "_e", "kind": "_k", "n": "_n", "m": "_m"})
    met = comparisons.join(by, (F.col("prompt_id") == F.col("_p")) & (F.col("evaluator_name") == F.col("_e")) & F.col("axis").eqNullSafe(F.col("_k")), "left")
    return met.select(*comparisons.columns, F.when((F.col("_n") > 0) & (F.col("_n") == F.col("_m")), F.col("_m")).alias("shared_miss"))


def records_of_slice(rows: DataFrame, comparisons: DataFrame, slice_name: str) -> DataFrame:
    """Records of the evaluators that have a comparison in a slice."""
    return rows.join(comparisons.where(F.col("slice_name") == slice_name).select("evaluator_name").distinct(), "evaluator_name", "left_semi")
