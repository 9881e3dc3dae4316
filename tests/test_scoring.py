"""Evaluators against plain-Python models."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import scoring as S
from pairloom.operators.arguments import call_score, contained, field_score


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def prefix(e, a):
    i = 0
    for x in a:
        i += i < len(e) and e[i] == x
    return i / len(e) if e else 1.0


def nearest(s, t):
    used, out = set(), []
    for n, q in s:
        best = min(((abs(u - q), i) for i, (m, u) in enumerate(t) if m == n and i not in used), default=None)
        if best:
            used.add(best[1])
            out.append((q, t[best[1]][1], best[1]))
    return out


def test_sequences(spark):
    rng = random.Random(2)
    pick = lambda: [rng.choice("abc") for _ in range(rng.randrange(6))]
    data = [(i, pick(), pick()) for i in range(300)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(data, "i int, a array<string>, b array<string>")
    got = df.select("i", S.lcs_length(a, b).alias("l"), S.sequence_match(a, b).alias("p"), S.multiset_recall(a, b).alias("m"), S.jaccard(a, b).alias("j"), S.first_match(a, b).alias("f"), S.exact_match(a, b).alias("x"), S.no_tools_score(a).alias("n")).collect()
    for r, (_, x, y) in zip(sorted(got, key=lambda r: r.i), data):
        assert r.l == lcs(x, y) and r.p == pytest.approx(prefix(x, y))
        assert r.m == pytest.approx(sum((Counter(x) & Counter(y)).values()) / len(x) if x else 1)
        assert r.j == pytest.approx(len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1)
        assert (r.f, r.x, r.n) == (float(bool(x) and bool(y) and x[0] == y[0]), float(x == y), float(not x))


def test_nearest_pairs(spark):
    rng = random.Random(4)
    side = lambda: [(rng.choice("ab"), q) for q in sorted(rng.sample(range(20), rng.randrange(6)))]
    data = [(i, side(), side()) for i in range(200)]
    kind = "array<struct<name:string,q:int>>"
    got = spark.createDataFrame(data, f"i int, s {kind}, t {kind}").select("i", S.nearest_pairs(F.col("s"), F.col("t")).alias("m")).collect()
    assert {r.i: [tuple(x) for x in r.m] for r in got} == {i: nearest(s, t) for i, s, t in data}


def test_text_scores(spark):
    df = spark.createDataFrame([("a" * 5,), ("",), (None,), ("a" * 30,), ("[1, 2]",)], "t string")
    got = [tuple(r) for r in df.select(S.length_score(F.col("t"), 10, 20), S.regex_score(F.col("t"), "^a+$"), S.json_score(F.col("t"))).collect()]
    assert got == [(0.5, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.5, 1.0, 0.0), (0.6, 0.0, 1.0)]


def test_cosine_of_degenerate_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("a", "b", "how", "want"),
    [
        (None, None, "auto", 1), ("{}", None, "auto", 1), ('{"a": 1}', '{"a": 1.0}', "exact", 1), ('{"a": "X  y"}', '{"a": "x Y"}', "auto", 1), ('{"a": "X"}', '{"a": "x"}', "exact", 0),
        ('{"a": 100, "b": 1}', '{"a": 100}', "auto", 0.5), ('{"a": 100}', '{"a": 101}', "numeric", 1 - 1 / 101 / 0.05), ('{"a": {"x": 1}}', '{"a": {"x": 1, "y": 2}}', "subset", 1),
        ('{"_p": 1}', '{"_p": 2}', "auto", 1), ('"{\\"a\\": 1}"', '{"a": 1}', "auto", 1), ("broken", '{"a": 1}', "auto", 0), ("broken", "broken", "auto", 0), ('{"a": true}', '{"a": 1}', "auto", 1),
    ],
)
def test_arguments(a, b, how, want):
    assert call_score(a, b, how) == pytest.approx(want)


def test_rules_of_fields():
    assert field_score("The Cat", "the  cat") == 1 and field_score("abcd", "abce") == 0.75 and field_score("AB", "ab c") == pytest.approx(0.0)
    assert field_score("x", "X", "unknown") == 0 and field_score("x", "x", "unknown") == 1 and field_score(1, "1", "semantic") == 1
    assert field_score(41, 42, schema={"type": "integer"}, field="project_id") == 0 and field_score(100, 101, schema={"type": "integer"}, field="n") == pytest.approx(1 - 1 / 101 / 0.05)
    assert field_score("2026-01-01", "2026-01-02", schema={"type": "string", "format": "date"}) == 0 and field_score("aa", "ab", schema={"type": ["null", "string"], "enum": ["aa"]}) == 0
    assert field_score([1], [1, 2], schema={"type": "array"}) == 1 and field_score("abcd", "abce", schema={"type": "string"}) == 0.75 and field_score(True, 1, schema={"type": "boolean"}) == 1
    assert call_score('{"a": 1, "b": 2}', '{"a": 1}', only={"a"}) == 1 and call_score('{"a": 1, "b": 2}', '{"a": 1}', without={"b"}) == 1 and call_score('{"a": "x"}', '{"a": "y"}', rules={"a": "exact"}) == 0


def test_expectations_count_what_either_side_made(spark):
    from pairloom.operators.arguments import expectation_scores

    data = [
        (1, '{"a": 1, "old": 2}', "subset", '{"a": 1, "z": 9}', True, '{"a": 5}', True),  # old: made by neither
        (2, '{"a": 1}', "exact", '{"a": 1, "z": 9}', True, None, False), (3, '{"a": 1}', "subset", None, False, "{bad", True),
    ]
    df = spark.createDataFrame(data, "i int, arguments string, match_strategy string, source_made string, source_met boolean, target_made string, target_met boolean")
    got = {r.i: (r.source_score, r.target_score) for r in expectation_scores(df).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.75, 0.0), 3: (0.0, 0.0)}


def test_fields():
    assert field_score(None, 1) == 0 and field_score(None, 1, strict=False) == 0.5 and contained([1, 1], [1, 2]) and not contained({"a": 1}, [])


def test_history_has_no_depth_and_keeps_users_and_the_system_message(spark):
    from pairloom.operators.captures import full_history

    event = "struct<type string, sequence_index int, input string, output string, text string, toolset_ref string>"
    listed = '[{"role": "system", "content": "sys"}, {"role": "user", "content": "u0"}]'

    def turn(i, text, reply="four", *more):
        return (i, "v", i, "", f"c{i}", {"events": [{"type": "model_call", "sequence_index": 0, "input": text, "output": reply, "text": None, "toolset_ref": "t"}, *more]})

    failed = {"type": "error", "sequence_index": 1, "input": None, "output": None, "text": None, "toolset_ref": None}
    data = [turn(0, listed), turn(1, "ask"), turn(2, "ask", None), turn(3, "ask", "four", failed), *[turn(i, "ask") for i in range(4, 31)]]
    df = spark.createDataFrame(data, f"row_id bigint, conversation_id string, turn_index int, created_at string, capture_id string, trace struct<events array<{event}>>")
    got = {r.place: (r.recorded, r.messages, r.chars) for r in full_history(df).collect()}
    assert got[0] == (True, 1, 3) and got[1] == (False, 3, 9) and got[2] == (False, 5, 16)
    assert got[3] == (False, 6, 19) == got[4]
    assert got[30] == (False, 6 + 2 * 26, 19 + 7 * 26)
