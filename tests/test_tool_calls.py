"""Shredding and linking on small records."""

from __future__ import annotations

from conftest import rows

from pairloom.operators.shred import adjacency, pivot_objects
from pairloom.operators.tool_calls import entity_tables, linked_calls

EVENT = "struct<type:string,sequence_index:int,name:string,call_id:string,tools_offered:array<string>>"
CAPTURE = f"row_id bigint, capture_id string, object string, trace struct<events:array<{EVENT}>>"
MESSAGE = "message_id bigint, capture_id string, tool_calls array<struct<id:string,type:string>>"


def captures(spark, data):
    return spark.createDataFrame([(i, c, "extra", None if e == "none" else (e,)) for i, c, e in data], CAPTURE)


def messages(spark, data):
    return spark.createDataFrame([(m, c, None if t is None else [(x, "function") for x in t]) for m, c, t in data], MESSAGE)


def test_links(spark):
    events = [
        ("tool_result", 9, "a", "1", None), ("tool_call", 0, "a", "1", None), ("model_call", 2, None, None, ["b", "a", "a"]), ("tool_call", 3, "a", "1", None),
        ("tool_call", 4, "z", None, None), ("tool_result", 5, "a", "1", None), ("model_call", 6, None, None, None), ("tool_call", 7, "b", "2", None), ("tool_call", 8, None, "3", []),
    ]
    c = captures(spark, [(1, "c", events), (2, "c", None), (3, None, [("tool_call", 0, "a", "1", None)]), (4, "d", "none"), (5, "e", [])])
    m = messages(spark, [(20, "c", ["1", None]), (10, "c", ["1"]), (10, "c", ["1"]), (5, "x", ["1"]), (6, None, ["1"]), (7, "c", None), (8, "c", [])])
    assert rows(linked_calls(c, m).select("row_id", "call_seq", "model_seq", "tool_pos", "result_seq", "message_id").toDF("a", "b", "c", "d", "e", "f")) == sorted(
        [(1, 0, -1, -1, 5, 10), (1, 3, 2, 1, 5, 10), (1, 4, 2, -1, -1, -1), (1, 7, 6, -1, -1, -1), (1, 8, 6, -1, -1, -1), (3, 0, -1, -1, -1, -1)], key=repr
    )


def test_empty_tables_and_entities(spark):
    c, m = captures(spark, [(1, "c", [("model_call", 0, None, None, ["a", None, "a"])])]), messages(spark, [(1, "c", ["x"])])
    assert rows(linked_calls(c.limit(0), m)) == [] and rows(linked_calls(c, m.limit(0))) == []
    tables = entity_tables(c, m)
    assert [(r.position, r.tool_name) for r in tables["offered"].orderBy("position").collect()] == [(0, "a"), (1, None), (2, "a")]
    assert tables["events"].count() == 1 and tables["results"].count() == 0 and tables["message_calls"].count() == 1


def test_shredding_is_lossless(spark):
    events = [("t", i, f"n{i}", None if i % 2 else "c", [f"x{j}" for j in range(i)]) for i in range(5)]
    c = captures(spark, [(1, "c", events)])
    nodes = adjacency(c, "row_id", ["capture_id"], {"trace.events": (["type", "sequence_index", "name", "call_id"], ["tools_offered"])})
    assert nodes.where("label = '[]'").count() == 5 and nodes.count() == 5 + 1 + 4 * 5 - 2 + sum(range(5))
    back = pivot_objects(nodes, ["type", "sequence_index", "name", "call_id"], ["tools_offered"]).where("type is not null").orderBy("ordinal").collect()
    assert [(r["type"], int(r["sequence_index"]), r["name"], r["call_id"], r["tools_offered"]) for r in back] == events
