"""Schema drift on small streams with known changes."""

from __future__ import annotations

import json

from conftest import rows

from pairloom.operators.drift import boundaries, changes, ingest, leaves, marks_of, replay
from pairloom.scratch import spool

SCHEMA = "file_name string, stream string, file_no int, line_no int, body string"


def files(spark, streams):
    out = []
    for stream, parts in streams.items():
        for file_no, records in parts.items():
            out += [("f", stream, file_no, i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(out, SCHEMA)


def report(spark, streams):
    df = files(spark, streams)
    return {tuple(r) for r in changes(df, spool(ingest(df), "t")).collect()}


def test_every_kind_of_change(spark):
    ids = lambda k: [f"cap_{k}{i:03d}ab" for i in range(8)]
    first = [{"capture_id": x, "turn_index": i, "usage": {"input_tokens": 900 + i}, "old": None} for i, x in enumerate(ids("a"))]
    second = [{"captureId": x, "turn_index": str(i), "usage": {"input_tokens": 900 + i}, "seeded": True} for i, x in enumerate(ids("b"))]
    got = report(spark, {"s": {1: first, 4: second}, "one": {3: first}})
    assert got == {("s", 4, "renamed", "capture_id", "captureId"), ("s", 4, "removed", "old", ""), ("s", 4, "added", "seeded", ""), ("s", 4, "retyped", "turn_index", "")}


def test_fields_that_stand_side_by_side_elsewhere_are_no_rename(spark):
    both = [{"a_flag": True, "b_flag": False}]
    got = report(spark, {"x": {1: both, 2: both}, "y": {1: [{"a_flag": True}], 2: [{"b_flag": True}]}})
    assert got == {("y", 2, "removed", "a_flag", ""), ("y", 2, "added", "b_flag", "")}


def test_cut_lines_nulls_and_empty_tables(spark):
    got = report(spark, {"s": {1: ['{"a": 1', None, "", "[1]", {"a": None}], 2: ['{"a"'], 3: [{"a": {}}]}})
    assert got == {("s", 2, "removed", "a", "")}
    empty = files(spark, {"s": {1: [{"a": 1}]}}).limit(0)
    assert rows(ingest(empty)) == [] and rows(boundaries(empty)) == [] and rows(changes(empty, spool(ingest(empty), "t"))) == []


def test_nothing_is_lost_and_approved_fields_come_back(spark):
    df = files(spark, {"s": {1: [{"capture_id": "c", "turn_index": "7", "captureId": "d", "nested": {"deep": {"x": [1, 2]}}, "cost_usd": 1}]}})
    row = ingest(df).first()
    assert (row.capture_id, row.turn_index, row.cost_usd) == ("c", None, 1.0)
    assert json.loads(row.rescued) == {"turn_index": "7", "captureId": "d", "nested.deep.x": [1, 2]}
    back = replay(ingest(df), {"turn_index": "turn_index", "captureId": "capture_id", "nested.deep.x": "nested.deep.x"}).first()
    assert (back.turn_index, back.capture_id, json.loads(back["nested__deep__x"])) == (7, "c", [1, 2])


def test_very_long_and_deep_values(spark):
    deep: dict = {"x": 1}
    for _ in range(50):
        deep = {"k": deep}
    row = ingest(files(spark, {"s": {1: [{"suite": "y" * 1_000_000, **deep}]}})).first()
    assert row.parsed and len(row.suite) == 1_000_000
    df = ingest(files(spark, {"s": {1: [{"suite": "y" * 1_000_000, **deep}]}}))
    assert {(r.path, r.type) for r in leaves(df).select("path", "type").collect()} == {("suite", "string"), (".".join(["k"] * 50 + ["x"]), "number")}


def test_captures_are_one_table_with_renamed_and_retyped_fields_filled(spark, tmp_path):
    from pairloom.plans.training import REGISTRY

    ids = [f"cap_{i:03d}ab" for i in range(8)]
    first = [{"capture_id": x, "turn_index": i, "latency_ms": 900 + i, "tags": ["a", "b"]} for i, x in enumerate(ids)]
    second = [{"captureId": x, "turn_index": [i], "latency_ms": f"{900 + i} ms", "tags": "a,b", "odd": i} for i, x in enumerate(ids)]
    second += [{"captureId": "cap_100ab", "turn_index": "late", "latency_ms": None, "tags": None}]
    files(spark, {"s": {1: first, 2: second}}).write.parquet(f"{tmp_path}/capture_files.parquet")
    got = REGISTRY.queries["p3_captures"](spark, str(tmp_path)).where("file_no = 2").orderBy("line_no").collect()
    assert [(r.capture_id, r.turn_index, r.latency_ms, r.tags, json.loads(r.rescued)) for r in got[:8]] == [(x, i, 900 + i, ["a", "b"], {"odd": i}) for i, x in enumerate(ids)]
    assert (got[8].capture_id, got[8].turn_index, json.loads(got[8].rescued)) == ("cap_100ab", None, {"turn_index": "late"})


def test_every_field_comes_back_from_typed_and_rescued_values(spark):
    record = {"suite": "7", "turn_index": 3, "cost_usd": 0.5, "cached": False, "tags": ["x", None], "latency_ms": "9 ms", "model_id": None, "free": {"n": 1e400 if False else 1.5, "big": 10**25, "list": [{"a": 1}], "none": None, "yes": True, "text": "true"}}
    got = {(r.path, r.type) for r in leaves(ingest(files(spark, {"s": {1: [record, "NaN", '{"x": NaN}']}}))).select("path", "type").collect()}
    assert got == {
        ("suite", "string"), ("turn_index", "number"), ("cost_usd", "number"), ("cached", "boolean"), ("tags", "array"), ("latency_ms", "string"), ("model_id", None), ("free.n", "number"),
        ("free.big", "number"), ("free.list", "array"), ("free.none", None), ("free.yes", "boolean"), ("free.text", "string"),
    }


def test_marks_look_at_every_element():
    import pandas as pd

    a, b, c = marks_of(pd.Series(["array"] * 3), pd.Series(['["k", "x"]', '["k", "y"]', "[]"]))
    assert a != b and a[0] == b[0] and c == ["[]"]
