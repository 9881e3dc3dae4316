"""Readers, writers, cache, streams and text functions."""

from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.sources import cache, jsonl
from pairloom.streaming import calls as ST


def lines(path, *items):
    path.write_text("".join((i if isinstance(i, str) else json.dumps(i)) + "\n" for i in items))
    return f"file://{path}"


def test_readers(spark, tmp_path):
    good = {"prompt_id": "p", "example_id": "e", "role": "source", "sample_index": 0, "cost_usd": 1.5}
    path = lines(tmp_path / "a.json", good, '{"prompt_id": "q", "exam', good)
    assert jsonl.read_tolerant(spark, path, jsonl.CALL).count() == 2
    fine, bad = jsonl.read_reporting(spark, path, jsonl.CALL)
    assert [r.cost_usd for r in fine.collect()] == [1.5, 1.5] and [r[jsonl.BAD] for r in bad.collect()] == ['{"prompt_id": "q", "exam']
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        jsonl.read_strict(spark, path, jsonl.CALL).collect()
    assert jsonl.read_or_empty(spark, f"file://{tmp_path}/none", jsonl.SCORE).count() == 0


def test_suites_and_files(spark, tmp_path):
    path = lines(tmp_path / "s.json", {"id": "a", "inputs": {"query": "x"}}, {"id": "a", "inputs": {}}, {"inputs": {}, "tags": ["t"]}, {"id": "b", "expected_no_tools": True, "expected_tools": [{"tool_name": "t"}]}, "{")
    fine, bad = jsonl.read_reporting(spark, path, jsonl.EXAMPLE)
    assert {(r.priority, r.what) for r in jsonl.suite_problems(fine, bad).collect()} == {(1, "{"), (2, "id"), (2, "inputs"), (2, "expected_no_tools"), (3, "a")}
    assert json.loads(fine.where("inputs is not null").first().inputs) == {"query": "x"}
    (tmp_path / "d").mkdir()
    lines(tmp_path / "d" / "1.json", json.dumps({"role": "source", "events": [{"type": "x"}]}, indent=1))
    lines(tmp_path / "d" / "2.json", "nonsense")
    got = jsonl.read_files(spark, f"file://{tmp_path}/d/*.json", jsonl.TRACE)
    assert sorted((r.parsed, r.role) for r in got.select("parsed", "role").collect()) == [(False, None), (True, "source")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("p", "b"), ("p", "a")], "prompt_id string, example_id string")
    out = f"file://{tmp_path}/out"
    jsonl.append_rows(df, out)
    fresh = jsonl.write_new(df.unionByName(spark.createDataFrame([("p", "c")], df.schema)), out, ["prompt_id", "example_id"], jsonl.CALL)
    assert [r.example_id for r in fresh.collect()] == ["c"] and jsonl.read_tolerant(spark, out, jsonl.CALL).count() == 3
    jsonl.write_sorted(df, f"file://{tmp_path}/sorted", ["example_id"])
    assert spark.read.json(f"file://{tmp_path}/sorted").count() == 2


def test_cache(spark):
    entries = spark.createDataFrame([("k", "2026-01-01 00:00:00", "old"), ("k", "2026-01-05 00:00:00", "new"), ("x", "2025-12-01 00:00:00", "stale")], "cache_key string, created_at string, value string").withColumn("created_at", F.to_timestamp("created_at"))
    asked = spark.createDataFrame([("k",), ("x",), ("y",), (None,)], "cache_key string")
    got = {r.cache_key: (r.hit, r.value) for r in cache.look_up(asked, entries, "2026-01-07 00:00:00").collect()}
    assert got == {"k": (True, "new"), "x": (False, None), "y": (False, None), None: (False, None)}
    assert cache.put(entries, entries).count() == 2


def test_streams_resume_and_do_not_repeat(spark, tmp_path):
    (tmp_path / "in").mkdir()
    call = lambda e, **k: {"prompt_id": "p", "example_id": e, "role": "source", "sample_index": 0, **k}
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/held"
    for i, part in enumerate(([call("a"), call("a"), "{cut"], [call("a"), call("b", error="x")])):
        lines(tmp_path / "in" / f"{i}.json", *part)
        ST.sync_new(ST.call_stream(spark, source), out, ST.CALL_KEY, f"file://{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.example_id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    timed = ST.call_stream(spark, source).withColumn("at", F.to_timestamp(F.lit("2026-01-01 00:00:30")))
    ST.append_to(ST.once_per_key(timed, "at", "1 hour"), f"file://{tmp_path}/once", f"file://{tmp_path}/cp2").awaitTermination(120)
    assert sorted(r.example_id for r in spark.read.parquet(f"file://{tmp_path}/once").collect()) == ["a", "b"]
    counts = ST.progress(timed.unionByName(timed), "at", "1 minute", "1 minute")
    query = counts.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.calls, r.failed) for r in spark.table("progress").collect()] == [(8, 2)]


def test_text_functions(spark):
    df = spark.createDataFrame([(" Ab--c! ", "Hi {name}, {a.b} {0} {{no}} {name!r}", '{"name": 1}', -0.125), (None, None, None, None), ("", "", "bad", 0.0)], "s string, t string, j string, v double")
    got = [tuple(r) for r in df.select(X.slug(F.col("s")), X.template_variables(F.col("t")), X.missing_variables(F.col("t"), F.col("j")), X.signed(F.col("v")), X.per_cent(F.col("v"))).collect()]
    assert got[0] == ("ab-c", ["name", "a"], ["a"], "−0.13", "-12.5%") and got[1][0] is None and got[1][3] is None and got[2][:4] == ("", [], [], "+0.00")
    two = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), ("x",), (None,)], "j string")
    prints = [r[0] for r in two.select(X.fingerprint(F.col("j"))).collect()]
    assert prints[0] == prints[1] and prints[2:] == [None, None] and X.canonical('{"b":1,"a":"é"}', False) == '{"a": "\\u00e9", "b": 1}'
    assert rows(spark.sql("select array(named_struct('name', 'a', 'spec', '1'), named_struct('name', 'b', 'spec', '2')) t").select(X.tools_fingerprint(F.col("t")))) == rows(
        spark.sql("select array(named_struct('name', 'b', 'spec', '2'), named_struct('name', 'a', 'spec', '1')) t").select(X.tools_fingerprint(F.col("t")))
    )


def test_small_texts_in_the_shared_folder(spark):
    from pairloom.scratch import discard, new_path, read_text, write_text

    path = new_path(spark, "note")
    for text in ("one", "zwei – 二"):
        write_text(spark, path, text)
        assert read_text(spark, path) == text
    discard(spark, path)
    with pytest.raises(ValueError, match="not a scratch path"):
        discard(spark, "file:///tmp/elsewhere")
