"""Agent traces of two sides: pairing, agreement scores, differences, and rounds.

Both sides of a pair are arrays in one row, so nothing here shuffles once pairs are made. Same-named calls meet by their
occurrence (the k-th with the k-th), which is the same as "the first unused one".

Defined results: null or missing events are no calls; arguments that are no JSON object have no fields, doubly encoded
ones are decoded; fields are equal if their JSON is; calls with a null name meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.scoring import exact_match, first_match, jaccard, multiset_recall, order_score, sequence_match

CALLS = "array<struct<name:string,arguments:string,q:int>>"
# Failure labels.
ORDER, ARGUMENT, DANGEROUS, NEEDLESS, UNVERIFIED = "TOOL_ORDER_DRIFT", "ARGUMENT_VALUE_DRIFT", "DANGEROUS_ACTION_DRIFT", "UNNECESSARY_TOOL_CALL", "MISSING_VERIFICATION_STEP"


def calls_of(events: str) -> Column:
    """The tool calls of an array of events in order of their index: name, arguments, q."""
    z = F.arrays_zip(*[F.col(f"{events}.{n}").alias(n) for n in ("type", "sequence_index", "name", "arguments")])
    made = F.transform(F.filter(z, lambda e: e["type"] == "tool_call"), lambda e: F.struct(e["sequence_index"].alias("q"), e["name"].alias("name"), e["arguments"].alias("arguments")))
    return F.coalesce(F.transform(F.array_sort(made), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), c["q"].cast("int").alias("q"))), F.array().cast(CALLS))


def numbered(calls: Column) -> Column:
    """Calls with ``k``, the how-manieth of its name a call is."""
    return F.transform(calls, lambda c, i: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), c["q"].alias("q"), F.size(F.filter(F.slice(calls, 1, i + 1), lambda x: x["name"] == c["name"])).alias("k")))


def trace_pairs(traces: DataFrame) -> DataFrame:
    """Both roles of every prompt and example: source_row, target_row (the first of each role), source_imports, target_imports.

    A role that was imported more than once makes the pair ambiguous, which ``error`` says. Keys with one role give no row.
    """
    role = lambda r, c: F.when(F.col("role") == r, c)
    sides = traces.groupBy("prompt_id", "example_id").agg(
        *[F.min(role(r, F.col("row_id"))).alias(f"{r}_row") for r in ("source", "target")],
        *[F.count(role(r, F.lit(1))).alias(f"{r}_imports") for r in ("source", "target")],
    )
    again = F.when((F.col("source_imports") > 1) | (F.col("target_imports") > 1), "duplicate trace")
    return sides.where("source_imports > 0 and target_imports > 0").withColumn("error", again)


def replays(traces: DataFrame) -> DataFrame:
    """What a prompt and example did first and what another trace of it did: prompt_id, example_id, source, target (calls).

    The other trace is the first of role target, or else the last that was imported. Keys with one trace give no row.
    """
    rows = traces.select("prompt_id", "example_id", "row_id", "role", calls_of("events").alias("calls"))
    first = F.col("role") == "source"
    keyed = rows.groupBy("prompt_id", "example_id").agg(
        F.min_by(F.struct("row_id", "calls"), F.struct(~F.coalesce(first, F.lit(False)), "row_id")).alias("a"),
        F.min_by(F.struct("row_id", "calls"), F.struct(F.coalesce(first, F.lit(True)), -F.col("row_id") * F.when(first, 1).otherwise(-1))).alias("b"),
    )
    return keyed.where("a.row_id <> b.row_id").select("prompt_id", "example_id", F.col("a.calls").alias("source"), F.col("b.calls").alias("target"))


def met_calls(source: Column, target: Column) -> Column:
    """Numbered calls of both sides that meet: array of (s, t)."""
    partner = lambda s: F.try_element_at(F.filter(target, lambda t: (t["name"] == s["name"]) & (t["k"] == s["k"])), F.lit(1))
    return F.filter(F.transform(source, lambda s: F.struct(s.alias("s"), partner(s).alias("t"))), lambda p: p["t"].isNotNull())


def argument_fields(text: Column) -> Column:
    """The fields of a JSON object as a map to their JSON."""
    once = F.try_parse_json(text)
    value = F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(once.cast("string"))).otherwise(once)
    fields = F.transform_values(value.cast("map<string,variant>"), lambda k, v: F.to_json(v))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), fields).otherwise(F.create_map().cast("map<string,string>"))


def with_fields(calls: Column) -> Column:
    """Numbered calls with their argument fields instead of the text."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["q"].alias("q"), c["k"].alias("k"), argument_fields(c["arguments"]).alias("fields")))


def field_changes(pair: Column) -> Column:
    """Names of the fields in which two calls differ, in order."""
    s, t = pair["s"]["fields"], pair["t"]["fields"]
    names = F.array_sort(F.array_union(F.map_keys(s), F.map_keys(t)))
    return F.filter(names, lambda n: ~F.try_element_at(s, n).eqNullSafe(F.try_element_at(t, n)))


def prepared(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides numbered and their arguments taken apart, and the calls that met."""
    sides = pairs.withColumns({c: with_fields(numbered(F.col(c))) for c in ("source", "target")})
    return sides.withColumn("met", met_calls(F.col("source"), F.col("target")))


def agent_trace_scores(pairs: DataFrame, dangerous: list[str], verifying: list[str], order: bool = True, arguments: bool = True, verification: bool = True) -> DataFrame:
    """Agreement of two traces: the pair's columns, order_score, argument_score, dangerous, unverified, target_score, categories.

    The target's score is the mean of the scores asked for, and of a 0 each for dangerous calls that the source did not
    make as often and for dangerous calls before any verifying one. Without any it is 1; the source's is always 1.
    """
    names = lambda c: F.transform(F.col(c), lambda x: x["name"])
    rows = prepared(pairs).withColumn("order_score", order_score(names("source"), names("target")))
    totals = F.aggregate("met", F.lit(0), lambda n, p: n + F.size(F.array_union(F.map_keys(p["s"]["fields"]), F.map_keys(p["t"]["fields"]))))
    rows = rows.withColumns({"_fields": totals, "drifts": F.aggregate("met", F.lit(0), lambda n, p: n + F.size(field_changes(p)))})
    none_met = F.when((F.size("source") == 0) & (F.size("target") == 0), 1.0).otherwise(0.0)
    agreement = F.when(F.size("met") == 0, none_met).when(F.col("_fields") == 0, 1.0).otherwise(1 - F.col("drifts") / F.col("_fields"))
    count = lambda c, n: F.size(F.filter(F.col(c), lambda x: x["name"] == n))
    risky = F.size(F.filter(F.array(*[F.lit(n) for n in dangerous]).cast("array<string>"), lambda n: count("target", n) > count("source", n)))
    start = F.struct(F.lit(False).alias("seen"), F.lit(0).alias("n"))

    def step(state: Column, call: Column) -> Column:
        seen = state["seen"] | F.coalesce(call["name"].isin(verifying), F.lit(False))
        bad = F.coalesce(call["name"].isin(dangerous), F.lit(False)) & ~seen
        return F.struct(seen.alias("seen"), (state["n"] + bad.cast("int")).alias("n"))

    unverified = F.aggregate("target", start, step)["n"] if dangerous and verifying and verification else F.lit(0)
    rows = rows.withColumns({"argument_score": agreement, "dangerous": risky, "unverified": unverified})
    parts = [F.when(F.lit(order), F.col("order_score")), F.when(F.lit(arguments), F.col("argument_score")), F.when(F.col("dangerous") > 0, 0.0), F.when(F.col("unverified") > 0, 0.0)]
    rows = rows.withColumn("_parts", F.array_compact(F.array(*parts)))
    mean = F.when(F.size("_parts") == 0, 1.0).otherwise(F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x) / F.size("_parts"))
    labels = [
        F.when(F.lit(arguments) & (F.col("drifts") > 0), ARGUMENT), F.when(F.col("dangerous") > 0, DANGEROUS), F.when(F.col("unverified") > 0, UNVERIFIED),
        F.when(F.lit(order) & (F.col("order_score") < 1), ORDER), F.when(F.col("dangerous") > 0, NEEDLESS),
    ]
    rows = rows.withColumns({"target_score": mean, "categories": F.array_compact(F.array(*labels))})
    return rows.drop("source", "target", "met", "_fields", "_parts")


def trace_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two traces, one a row: keys, kind, category, source_q, target_q, name, field.

    ``missing`` and ``extra`` are the last calls of a name that the other side made less often, ``reordered`` are calls
    that met at different indexes, ``argument_drift`` is a field in which calls that met differ.
    """
    kind = "array<struct<kind:string,category:string,source_q:int,target_q:int,name:string,field:string>>"
    item = lambda k, c, s, t, n, f: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("category"), s.cast("int").alias("source_q"), t.cast("int").alias("target_q"), n.alias("name"), f.cast("string").alias("field"))
    none = F.lit(None)
    surplus = lambda a, b: F.filter(F.col(a), lambda x: x["name"].isNotNull() & (x["k"] > F.size(F.filter(F.col(b), lambda y: y["name"] == x["name"]))))
    items = F.concat(
        F.transform(surplus("source", "target"), lambda x: item("missing", ORDER, x["q"], none, x["name"], none)).cast(kind),
        F.transform(surplus("target", "source"), lambda x: item("extra", ORDER, none, x["q"], x["name"], none)).cast(kind),
        F.transform(F.filter("met", lambda p: ~p["s"]["q"].eqNullSafe(p["t"]["q"])), lambda p: item("reordered", ORDER, p["s"]["q"], p["t"]["q"], p["s"]["name"], none)).cast(kind),
        F.flatten(F.transform("met", lambda p: F.transform(field_changes(p), lambda f: item("argument_drift", ARGUMENT, p["s"]["q"], p["t"]["q"], p["s"]["name"], f)))).cast(kind),
    )
    return prepared(pairs).select(*keys, F.inline(items))


# ---------------------------------------------------------------- rounds

ROUND = "array<struct<requested:array<string>,executed:array<string>>>"


def capture_rounds(captures: DataFrame, *keep: str) -> DataFrame:
    """The rounds of a capture: ``keep``, rounds (array of requested and executed names).

    A round begins at a model call; calls before any are a round of their own.
    """
    z = F.arrays_zip(*[F.col(f"trace.events.{n}").alias(n) for n in ("sequence_index", "type", "name", "requested_tool_calls")])
    ordered = F.array_sort(F.transform(F.filter(z, lambda e: e["type"].isin("model_call", "tool_call")), lambda e: F.struct(e["sequence_index"].alias("q"), e["type"].alias("type"), e["name"].alias("name"), F.transform(e["requested_tool_calls"], lambda c: c["name"]).alias("asked"))))
    names = "array<string>"

    def step(rounds: Column, e: Column) -> Column:
        opened = F.concat(rounds, F.array(F.struct(F.coalesce(e["asked"], F.array().cast(names)).alias("requested"), F.array().cast(names).alias("executed"))).cast(ROUND))
        last = F.try_element_at(rounds, F.lit(-1))
        grown = F.struct(F.coalesce(last["requested"], F.array().cast(names)).alias("requested"), F.concat(F.coalesce(last["executed"], F.array().cast(names)), F.array(e["name"])).alias("executed"))
        kept = F.when(F.size(rounds) > 0, F.slice(rounds, F.lit(1), F.size(rounds) - 1)).otherwise(F.array().cast(ROUND))
        return F.when(e["type"] == "model_call", opened).otherwise(F.concat(kept, F.array(grown).cast(ROUND)))

    rounds = F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<q:int,type:string,name:string,asked:array<string>>>")), F.array().cast(ROUND), step)
    return captures.select(*keep, rounds.alias("rounds"))


def padded(rounds: Column, count: Column) -> Column:
    """Rounds (arrays of names) with empty ones up to ``count``: a side that stopped early called nothing."""
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.get(rounds, i), F.array().cast("array<string>")))


def _mean(scores: Column) -> Column:
    """Mean of an array; 1 if nothing was measured."""
    return F.when(F.size(scores) == 0, 1.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores))


def round_divergence(source: Column, target: Column, mode: str = "exact", expected: Column | None = None) -> Column:
    """Mean agreement (exact, set or first) of two sides over the rounds in which either called, or was to call, anything."""
    compare = {"exact": exact_match, "set": jaccard, "first": first_match}[mode]
    count = F.greatest(F.size(source), F.size(target))
    s, t = padded(source, count), padded(target, count)
    wanted = padded(expected, count) if expected is not None else F.transform(s, lambda x: F.array().cast("array<string>"))
    each = F.arrays_zip(s.alias("s"), t.alias("t"), wanted.alias("w"))
    measured = F.filter(each, lambda r: (F.size(r["s"]) > 0) | (F.size(r["t"]) > 0) | (F.size(r["w"]) > 0))
    return _mean(F.transform(measured, lambda r: compare(r["s"], r["t"])))


def round_conformance(expected: Column, side: Column, count: Column, other: Column, mode: str = "sequence") -> Column:
    """Mean agreement (sequence or multiset) of a side with the expected rounds; null without any expected round.

    Beyond the expected rounds nothing is to be called. Rounds in which neither side called nor was to call are left out.
    """
    match = {"sequence": sequence_match, "multiset": multiset_recall}[mode]
    w, s, o = padded(expected, count), padded(side, count), padded(other, count)
    each = F.filter(F.arrays_zip(w.alias("w"), s.alias("s"), o.alias("o")), lambda r: (F.size(r["w"]) > 0) | (F.size(r["s"]) > 0) | (F.size(r["o"]) > 0))
    score = F.transform(each, lambda r: F.when(F.size(r["w"]) > 0, match(r["w"], r["s"])).when(F.size(r["s"]) == 0, 1.0).otherwise(0.0))
    return F.when(F.size(expected) > 0, _mean(score))


def covered_rounds(rounds: DataFrame, key: str) -> DataFrame:
    """Leading rounds of which every call has its result: key, replayable (number of rounds).

    ``rounds``: key, round, call_q, result_q (null without a result), as :func:`pairloom.operators.captures.pair_results`
    gives them.
    """
    bad = F.min(F.when(F.col("result_q").isNull(), F.col("round")))
    return rounds.groupBy(key).agg(bad.alias("_bad"), F.array_sort(F.collect_set("round")).alias("_rounds")).select(key, F.size(F.filter("_rounds", lambda r: F.col("_bad").isNull() | (r < F.col("_bad")))).cast("bigint").alias("replayable"))
