"""Traces, rounds, dispatch and stream caps against plain-Python models."""

from __future__ import annotations

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import captures as C
from pairloom.operators import dispatch as D
from pairloom.operators import traces as A

EVENT = "struct<type:string,sequence_index:int,name:string,arguments:string>"


def trace(*calls):
    return [("tool_call", i, n, json.dumps(a) if isinstance(a, dict) else a) for i, (n, a) in enumerate(calls)]


def pair(spark, source, target):
    df = spark.createDataFrame([("p", "e", 1, "source", trace(*source)), ("p", "e", 2, "target", trace(*target))], f"prompt_id string, example_id string, row_id bigint, role string, events array<{EVENT}>")
    return A.replays(df)


def test_equal_traces_and_drifts(spark):
    same = A.agent_trace_scores(pair(spark, [("get", {"a": 1}), ("pay", {})], [("get", {"a": 1}), ("pay", {})]), ["pay"], ["get"]).first()
    assert (same.target_score, same.categories) == (1.0, [])
    drift = A.agent_trace_scores(pair(spark, [("get", {"a": 1, "b": 2}), ("pay", {"n": 1})], [("pay", {"n": 1}), ("get", {"a": 1, "b": 3})]), ["pay"], ["get"]).first()
    assert (drift.order_score, drift.argument_score, drift.unverified, drift.dangerous) == (0.5, pytest.approx(2 / 3), 1, 0)
    assert drift.target_score == pytest.approx((0.5 + 2 / 3) / 3) and drift.categories == ["ARGUMENT_VALUE_DRIFT", "MISSING_VERIFICATION_STEP", "TOOL_ORDER_DRIFT"]
    risky = A.agent_trace_scores(pair(spark, [], [("pay", {})]), ["pay"], []).first()
    assert (risky.order_score, risky.argument_score, risky.dangerous, risky.target_score) == (0.0, 0.0, 1, 0.0) and "UNNECESSARY_TOOL_CALL" in risky.categories
    none = A.agent_trace_scores(pair(spark, [], []), ["pay"], ["get"], order=False, arguments=False).first()
    assert none.target_score == 1.0


def test_diff_items(spark):
    d = A.trace_diff(pair(spark, [("a", {"x": 1}), ("a", {}), ("b", '"{\\"y\\": 1}"')], [("b", {"y": 1}), ("a", {"x": 2, "z": None}), ("c", "broken")]), ["prompt_id"])
    got = {(r.kind, r.source_q, r.target_q, r.name, r.field) for r in d.collect()}
    assert got == {("missing", 1, None, "a", None), ("extra", None, 2, "c", None), ("reordered", 0, 1, "a", None), ("reordered", 2, 0, "b", None), ("argument_drift", 0, 1, "a", "x"), ("argument_drift", 0, 1, "a", "z")}


def test_pairs_need_both_roles_and_tell_repeats(spark):
    df = spark.createDataFrame([("p", "e", 1, "source"), ("p", "e", 2, "target"), ("p", "e", 3, "target"), ("q", "e", 4, "source"), (None, "e", 5, "source"), (None, "e", 6, "target"), ("r", "e", 7, None)], "prompt_id string, example_id string, row_id bigint, role string")
    got = {r.prompt_id: (r.source_row, r.target_row, r.error) for r in A.trace_pairs(df).collect()}
    assert got == {"p": (1, 2, "duplicate trace"), None: (5, 6, None)}
    assert rows(A.trace_pairs(df.limit(0))) == []


def test_rounds(spark):
    df = spark.createDataFrame([(1, [["a"], ["b", "c"], []], [["a"], ["c"]]), (2, [], []), (3, [[]], [["x"]])], "i int, s array<array<string>>, t array<array<string>>")
    s, t = F.col("s"), F.col("t")
    got = {r.i: tuple(r)[1:] for r in df.select("i", A.round_divergence(s, t), A.round_divergence(s, t, "set"), A.round_divergence(s, t, "first"), A.round_conformance(s, t, F.greatest(F.size(s), F.size(t)), s), A.round_conformance(s, t, F.greatest(F.size(s), F.size(t)), s, "multiset")).collect()}
    assert got[1] == (0.5, 0.75, 0.5, 0.5, 0.75) and got[2] == (1.0, 1.0, 1.0, None, None) and got[3] == (0.0, 0.0, 0.0, 0.0, 0.0)
    event = "array<struct<sequence_index:int,type:string,name:string,requested_tool_calls:array<struct<name:string>>>>"
    events = [(1, "model_call", None, [("a",), ("b",)]), (0, "tool_call", "early", None), (2, "tool_call", "b", None), (3, "tool_result", "b", None), (4, "model_call", None, None), (5, "tool_call", "c", None), (6, "tool_call", "c", None)]
    caps = spark.createDataFrame([(1, (events,)), (2, (None,)), (3, None)], f"row_id int, trace struct<events:{event}>")
    got = {r.row_id: [(x.requested, x.executed) for x in r.rounds] for r in A.capture_rounds(caps, "row_id").collect()}
    assert got == {1: [([], ["early"]), (["a", "b"], ["b"]), ([], ["c", "c"])], 2: [], 3: []}


def test_dispatch_prefers_failures(spark):
    call = "struct<text:string,error:string,finish_reason:string>"
    df = spark.createDataFrame([(1, ("a", None, "stop"), ("", None, "stop")), (2, ("a", "x", None), ("a", "y", "length")), (3, ("a", None, "length"), ("b", None, None))], f"i int, source {call}, target {call}")
    score = lambda r: F.when(F.col(f"{r}.text") != "", 1.0)
    got = {r.i: (r.recorded, r.source_score, r.delta, r.error) for r in D.records(df, [D.Axis("e", "k", score("source"), score("target"))], ["i"]).collect()}
    assert got == {1: (False, 1.0, None, None), 2: (True, 0.5, 0.0, "upstream call failed: x; y"), 3: (True, 0.5, 0.0, "output truncated (token cap)")}


def test_kinds_gates_and_shared_misses(spark):
    kinds = spark.createDataFrame([("a.x", ""), ("a.x", "b"), ("z", "a"), (None, None)], "n string, k string").select(D.is_kind(F.col("n"), F.col("k"), "a", "a."))
    assert [r[0] for r in kinds.collect()] == [True, False, True, False]
    comparisons = spark.createDataFrame([("p", "e", None, ["nothing measured: all failed"]), ("p", "f", "k", []), ("p", "g", None, ["nothing measured: x"]), ("p", "h", None, ["advisory", "nothing measured: x"])], "prompt_id string, evaluator_name string, axis string, notes array<string>")
    records = spark.createDataFrame([("p", "f", "k", None, True, True), ("p", "f", "j", None, False, True), ("p", "g", "k", "failed", True, False)], "prompt_id string, evaluator_name string, kind string, error string, miss boolean, blocking boolean")
    assert {r.evaluator_name for r in D.unmeasured_gates(comparisons, records).collect()} == {"e"}
    assert {r.evaluator_name: r.shared_miss for r in D.shared_misses(comparisons, records).collect()} == {"e": None, "f": 1, "g": None, "h": None}


def brute_stream(events, most_result, most_stream):
    out, rounds, models, cut = [], 0, 0, False
    for e in sorted(events, key=lambda e: (e["sequence_index"] is None, e["sequence_index"] or 0)):
        models += e["type"] == "model_call"
        fields = {n: e[n] for n in C.SENT.get(e["type"], [])}
        if e["type"] == "tool_result":
            text = json.dumps(fields["result"])
            over = len(text) > most_result
            if over:
                fields["result"] = {"_truncated": True, "_original_bytes": len(text), "preview": "?"}
                cut = True
            fields["truncated"] = over
        out.append({"type": e["type"], "sequence_index": len(out), "round": max(models - 1, 0), "timestamp": e["timestamp"], **fields})
    whole = len(json.dumps(out))
    if whole <= most_stream:
        return len(out), cut, whole
    size = 2
    for n, e in enumerate(out):
        if size + len(json.dumps(e)) + 1 > most_stream:
            return n, True, size
        size += len(json.dumps(e)) + 1
    return len(out), True, size


def test_streams_are_capped_like_escaped_json(spark):
    rng = random.Random(3)
    names = sorted({n for f in C.SENT.values() for n in f})
    kinds = {"input_tokens": "int", "output_tokens": "int", "cost_usd": "double", "latency_ms": "int", "documents": "array<string>"}
    texts = [None, "", "plain", 'quo"te\\', "tab\tnew\nline\x01", "é漢🙂", "x" * 40]
    data, want = [], {}
    for i in range(60):
        events = []
        for k in range(rng.randrange(0, 7)):
            e = {n: rng.choice(texts) for n in names}
            e |= {"input_tokens": rng.choice([None, 5, 1234]), "output_tokens": 7, "latency_ms": None, "cost_usd": rng.choice([None, 0.25, 1.0]), "documents": rng.choice([None, [], ["a", "é"]])}
            e |= {"type": rng.choice([*C.SENT, "other"]), "sequence_index": k * 2, "timestamp": rng.choice([None, "2026"])}
            events.append(e)
        rng.shuffle(events)
        data.append((i, (events,)))
        if events:
            want[i] = brute_stream(events, 10**9, 500)
    columns = ",".join(f"{n}:{kinds.get(n, 'string')}" for n in ["type", "sequence_index", "timestamp", *names]).replace("sequence_index:string", "sequence_index:int")
    df = spark.createDataFrame(data, f"row_id int, trace struct<events:array<struct<{columns}>>>")
    got = {r.row_id: (r.kept, r.truncated, r.size) for r in C.cap_streams(df, 10**9, 500).collect()}
    assert got == want
    cut = {r.row_id: r.truncated for r in C.cap_streams(df, 20, 10**9).collect()}
    assert cut == {i: any(e["type"] == "tool_result" and len(json.dumps(e["result"])) > 20 for e in d[0]) for i, d in data if d[0]}
