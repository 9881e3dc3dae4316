"""The llm operators against brute force, exact round trips and small known cases."""

from __future__ import annotations

import json
import math
import os
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from conftest import DATA, duck, duck_rows, rows
from pyspark.sql import functions as F

from pairloom.llm import history as H
from pairloom.llm import mixing as M
from pairloom.llm import queries, reading, sketch, tokenizer, topn
from pairloom.llm.dialogues import nearest_ancestor, sound_turns, whole_dialogues

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", list(queries.REGISTRY.sql))
def test_query_matches_sql(spark, name):
    df = queries.REGISTRY.queries[name](spark, FOLDER)
    names, want = duck_rows(duck(FOLDER), queries.REGISTRY.sql[name])
    assert sorted(df.columns) == names and rows(df) == want


# ---------------------------------------------------------------- top N


def test_top_n_equals_sorting(spark):
    rng = random.Random(3)
    data = []
    for i in range(1500):
        g = rng.choice(["hot"] * 6 + ["a", "b", "c", None, ""])
        score = rng.choice([-1.0, -0.5, 0.0, -0.0, float("-inf"), float("nan"), None, 1e300, rng.gauss(0, 1)])
        data.append((g, "k", score, rng.choice(["x", "xy", "x\0", "long" * 9 + "a", "long" * 9 + "b", None, "é", ""]), i))
    df = spark.createDataFrame(data, "g string, h string, score double, id string, n bigint").withColumn("code", F.lit(1)).withColumn("slot", F.lit(2))
    for n in (1, 7, 10_000):
        got = topn.top_n(df, ["g", "h"], "score", "id", "n", n)
        want = []
        for g in {d[0] for d in data} - {None}:
            own = sorted((d[2] + 0.0, d[3] is None, (d[3] or "").encode(), d[4]) for d in data if d[0] == g and d[2] is not None and d[2] == d[2])
            want += [(g, i + 1, x[3]) for i, x in enumerate(own[:n])]
        assert sorted((r.g, r.rank_no, r.n) for r in got.collect()) == sorted(want)
    assert topn.top_n(df.limit(0), ["g"], "score", "id", "n", 3).count() == 0


def test_repeats_count_once(spark):
    data = [(1, "a", 0.0, None), (2, "a", -0.0, None), (3, "a", 0.0, "x"), (4, None, float("nan"), None), (5, None, float("nan"), None)]
    df = spark.createDataFrame(data, "k bigint, g string, v double, t string")
    assert sorted(r.k for r in topn.first_of_repeats(df, "k", ["g"]).collect()) == [1, 3, 4]


def test_codes_keep_the_order():
    import pandas as pd

    x = np.sort(np.concatenate([np.random.default_rng(0).normal(size=500) * 10.0 ** np.arange(500).clip(0, 300), [0.0, -np.inf, np.inf, 5e-324, -5e-324]]))
    assert (np.diff(topn.ordered_code(pd.Series(x)).to_numpy().astype(object)) > 0).all()


# ---------------------------------------------------------------- percentiles


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_percentiles_are_within_the_bound_and_merge(spark, error):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(0, 4, 3000), -rng.lognormal(0, 4, 1000), np.zeros(200), [1e-300, -1e-300, 1.0, -1.0]])
    data = [("hot" if i % 3 else "g", i % 5, float(v)) for i, v in enumerate(values)] + [("hot", 0, None), ("hot", 0, float("nan")), ("void", 0, None), (None, 1, 5.0)]
    df = spark.createDataFrame(data, "g string, day int, v double")
    parts = sketch.sketch(df, ["day", "g"], "v", error)
    got = sketch.percentiles(sketch.merge(parts, ["g"]), ["g"], {"p1": 10, "p50": 500, "p99": 990}, error).collect()
    assert sorted(str(r.g) for r in got) == ["None", "g", "hot"]
    for r in got:
        own = sorted(v for g, _, v in data if g == r.g and v is not None and v == v)
        assert r.n == len(own)
        for name, q in (("p1", 10), ("p50", 500), ("p99", 990)):
            exact = own[max(1, -(-q * len(own) // 1000)) - 1]
            assert abs(r[name] - exact) <= error * abs(exact) * (1 + 1e-9)
    assert sketch.percentiles(sketch.sketch(df.limit(0), ["g"], "v"), ["g"], {"p50": 500}).count() == 0


def test_calls_appended_twice_count_once(spark):
    schema = "run_id string, prompt_id string, example_id string, role string, sample_index int, latency_ms int, cost_usd double, metric string"
    df = spark.createDataFrame([("r", "p", "e", "source", 0, 100, 0.0, "x")] * 2 + [("r", "p", "e", "target", 0, -1, None, "x"), ("r", None, "e", None, None, None, float("nan"), "x")], schema)
    assert sorted((r.metric, r.n, r.sign) for r in sketch.call_sketches(df).collect()) == [("cost_usd", 1, 0), ("latency_ms", 1, 1)]


# ---------------------------------------------------------------- history


def brute(data):
    import re

    kept, out = [], set()
    for r, batch, own, h, text in sorted(data):
        t = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower())
        c = Counter(t)
        hit = None
        if batch > 0:
            for k, o, g, d, n in kept:
                near = n >= 20 and len(t) >= 20 and 5 * sum((c & d).values()) >= 4 * max(n, len(t))
                if (own and own == o) or (h and h == g) or near:
                    hit = k
                    break
        if hit is None:
            kept.append((r, own, h, c, len(t)))
        else:
            out.add((hit, r))
    return out


def test_history_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Straße", "ﬁne", "ÉTÉ"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))] for _ in range(30)]
    data, row = [], 0
    for batch in range(4):
        for _ in range(70):
            row += rng.randrange(1, 3)
            words = list(rng.choice(bases)) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))]
            for _ in range(rng.randrange(0, 1 + max(1, len(words) // 6))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
            text = rng.choice([" ".join(words), ", ".join(words).upper(), None if rng.random() < 0.1 else " ".join(words), "copy " * 30 if rng.random() < 0.5 else "short one"])
            data.append((batch * 1000 + row, batch, rng.choice([None, f"c:{rng.randrange(200)}"]), rng.choice([None, None, f"h:{rng.randrange(120)}"]), text))
    df = spark.createDataFrame(data, "row_id bigint, batch_no int, own_id string, hash string, request string")
    got = [tuple(r) for r in H.replay_batches(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data) and got


def test_hot_families_are_settled_without_all_pairs(spark, monkeypatch):
    rng = random.Random(6)  # no pair of this seed misses its bands
    base = [f"t{i}" for i in range(40)]
    data = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(40)] = f"x{rng.randrange(30)}"
        data.append((i, rng.choice([1, 1, 1, 2]), rng.choice([None, f"c:{rng.randrange(60)}"]), None, " ".join(words)))
    df = spark.createDataFrame(data, "row_id bigint, batch_no int, own_id string, hash string, request string")
    monkeypatch.setattr(H, "HOT", 4)
    want = {(k, r) for k, r in brute([(r + 1000 * b, b, o, h, t) for r, b, o, h, t in data])}
    got = H.replay_batches(df.withColumn("row_id", F.col("row_id") + 1000 * F.col("batch_no")))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_an_index_goes_on_in_another_session_and_is_read_by_key(spark, monkeypatch):
    monkeypatch.setattr(H, "PAGE", 50)
    monkeypatch.setattr(H, "COMPACT_AFTER", 3)
    schema = "row_id bigint, batch_no int, own_id string, hash string, request string"
    text = lambda i: " ".join(f"w{i}_{k}" for k in range(25))
    read = {}
    for size in (300, 3000):
        history = H.History(spark, buckets=16)
        history.start(H.with_features(spark.createDataFrame([(i, 0, f"c:{i}", None, text(i)) for i in range(size)], schema)))
        path = history.path
        history.close()
        history = H.History.open(spark, path)
        batch = H.with_features(spark.createDataFrame([(size + 1, 1, "c:x", None, text(7) + " more"), (size + 2, 1, "c:8", None, None), (size + 3, 1, "c:y", None, "new")], schema))
        rows_ = H.spool(H.with_classes(batch), "probe")
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(H.FEW_KEYS))
        probe = history.probe(rows_)
        assert rows(probe) == [(7, size + 1), (8, size + 2)]
        read[size] = sum(_scanned(probe._jdf.queryExecution().executedPlan(), "entries"))
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "10")
        assert rows(history.take(batch)) == [(size + 1, 7), (size + 2, 8)]
        again = H.with_features(spark.createDataFrame([(size + 9, 2, "c:y", None, text(7))], schema))
        assert rows(history.take(again)) == [(size + 9, 7)] and history.generation == 1 and history.appends == 0
        assert rows(history.take(again)) == [(size + 9, 7)]
        history.drop()
    # Ten times the history, the same batch: the scan reads about the same rows.
    assert 0 < read[3000] < 3 * read[300] + 2000 and read[3000] < 3000 * 64 / 4


def test_a_batch_leaves_small_plans_to_the_driver(spark):
    # The driver keeps every node's metrics of a session's last thousand plans, and of each that adaptive execution made on the way.
    base = [[f"t{f}i{i}" for i in range(30)] for f in range(8)]
    data = [(100 * b + 12 * k + f, b, None, None, " ".join([*base[f][: 30 - k], *[f"x{f}k{k}j{j}" for j in range(k)]])) for b in (1, 2) for k in range(6) for f in range(4 * b - 4, 4 * b)]
    df = spark.createDataFrame(data, "row_id bigint, batch_no int, own_id string, hash string, request string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {tuple(r) for r in H.replay_batches(df).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == brute(data) and len(got) == 40
    plans = store.executionsList(before, store.executionsCount() - before)
    sizes = [plans.apply(i).metrics().size() for i in range(plans.size())]
    assert len(sizes) < 1000 and max(sizes) < 2500 and sum(sizes) / 2 < 11_000, (max(sizes), sum(sizes) / 2, len(sizes))


def test_the_plans_of_a_batch_do_not_repeat_its_parts(spark):
    # Copies, near texts and shared identifiers: no plan may be made of several copies of the batch's rows and matches.
    base = [[f"t{f}i{i}" for i in range(30)] for f in range(6)]
    near = lambda f, k: " ".join([*base[f][: 30 - k], *[f"x{f}k{k}j{j}" for j in range(k)]])
    data = [(100 * b + 12 * k + f, b, f"c:{b}{k % 4}{f}" if f % 2 else None, None, near(f, k // 2)) for b in (1, 2) for k in range(6) for f in range(3 * b - 3, 3 * b)]
    df = spark.createDataFrame(data, "row_id bigint, batch_no int, own_id string, hash string, request string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {tuple(r) for r in H.replay_batches(df).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == brute(data) and len(got) == 30
    plans = store.executionsList(before, store.executionsCount() - before)
    sizes = [plans.apply(i).metrics().size() for i in range(plans.size())]
    assert max(sizes) < 1200 and sum(sizes) / 2 < 8000, (max(sizes), sum(sizes) / 2, len(sizes))


def _scanned(plan, table):
    """Rows that the scans of a table read."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from _scanned(plan.executedPlan(), table)
        return
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from _scanned(plan.plan(), table)
        return
    if plan.getClass().getSimpleName() == "FileSourceScanExec" and table in plan.simpleStringWithNodeId():
        yield plan.metrics().apply("numOutputRows").value()
    for i in range(plan.children().size()):
        yield from _scanned(plan.children().apply(i), table)


def test_requests_hashes_and_long_texts(spark):
    df = spark.createDataFrame([("SHA256:" + "A" * 64,), ("a" * 64,), ("0" * 64,), ("sha256:" + "0" * 64,), ("xyz",), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(H.usable_hash(F.col("h"))).collect()] == ["a" * 64, "a" * 64, None, None, None, None, None]
    event = "array<struct<type:string,sequence_index:int,input:string>>"
    said = lambda *m: json.dumps([{"role": r, "content": c} for r, c in m])
    data = [
        (1, ([("model_call", 5, said(("user", "late"))), ("model_call", 1, said(("user", "a"), ("user", "b"), ("assistant", "c")))],)), (2, ([("model_call", 1, "broken")],)), (3, (None,)), (4, None),
        (5, ([("model_call", None, said(("user", "x")))],)), (6, ([("model_call", 1, said(("assistant", "x")))],)), (7, ([],)),
    ]
    df = spark.createDataFrame(data, f"i int, trace struct<events:{event}>")
    assert {r.i: r.q for r in df.select("i", H.request_of_capture().alias("q")).collect()} == {1: "b", 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    long = " ".join(f"w{i}" for i in range(30_000))
    data = [(1, 0, "c:1", None, long), (2, 1, "c:2", None, long + " more"), (3, 1, None, None, None), (4, 2, None, None, "")]
    got = H.replay_batches(spark.createDataFrame(data, "row_id bigint, batch_no int, own_id string, hash string, request string"))
    assert rows(got) == [(2, 1)] or rows(got) == [(1, 2)]
    assert H.replay_batches(spark.createDataFrame([], "row_id bigint, batch_no int, own_id string, hash string, request string")).count() == 0


def test_candidates_are_found_at_the_limit():
    rng = np.random.default_rng(4)
    a, b = H._multipliers(H.ROWS * H.BANDS, 7)
    lost = 0
    for _ in range(300):  # 50 words, 40 in common: the least similar pair that counts
        words = rng.integers(0, 2**63, 60, dtype=np.uint64)
        x, y = H._minima(words[:50], a, b).reshape(H.BANDS, -1), H._minima(words[10:], a, b).reshape(H.BANDS, -1)
        lost += not (x == y).all(axis=1).any()
    assert lost <= 6


# ---------------------------------------------------------------- dialogues

CAPTURE = "capture_id string, conversation_id string, turn_index int, parent_capture_id string, role string"
MESSAGE = "message_id bigint, capture_id string, seq int, role string, content string"


def talk(*captures, skip=()):
    return [(i * 10 + k, c, k, r, t) for i, c in enumerate(captures) for k, (r, t) in enumerate((("Human", "q"), ("MODEL", "a"), ("tool", None))) if (c, k) not in skip]


def test_conversations(spark):
    captures = [
        ("a0", "A", 3, None, "x"), ("a1", "A", None, "a0", "x"), ("a2", None, None, "a1", "x"), ("a2", None, None, "a1", "x"),  # sound; one turn came twice
        ("b0", "B", 0, None, "x"), ("b2", "B", 2, None, "x"),  # gap
        ("c0", "C", 0, None, "x"), ("c1", "C", 0, None, "x"),  # place held twice
        ("d0", "D", 0, None, "x"), ("d1", "D", 1, "zz", "x"),  # parent elsewhere
        ("e0", "E", None, "e1", "x"), ("e1", "E", None, "e0", "x"),  # circle
        ("f0", "F", 0, None, "x"),  # no reply
        ("g0", None, 0, None, "x"), ("h0", "H", 0, "a0", "x"),  # nowhere; parent of another conversation
    ]
    names = sorted({c[0] for c in captures})
    c = spark.createDataFrame(captures, CAPTURE)
    m = spark.createDataFrame(talk(*names, skip={("f0", 1)}) + talk(*names, skip={("f0", 1)}) + [(999, "f0", 9, "assistant", " \n\t "), (1000, None, 0, "user", "x"), (1001, "f0", None, None, None)], MESSAGE)
    assert rows(sound_turns(c, m)) == [("a0", "A", 0), ("a1", "A", 1), ("a2", "A", 2)]
    d = whole_dialogues(c, m.withColumns({"tool_calls": F.lit(None).cast("array<string>"), "tool_call_id": F.lit(None).cast("string")}))
    assert d.count() == 9 and {r.role for r in d.collect()} == {"user", "assistant", "tool"}
    assert rows(sound_turns(c.limit(0), m)) == [] and rows(sound_turns(c, m.limit(0))) == []


def test_sessions_split_at_calibrated_silences(spark):
    from pairloom.llm import sessions as by_time

    minute, hour = 60, 3600
    at = lambda s: str(1_700_000_000 + s)
    captures = []
    for c in range(20):  # two sessions of a channel, days apart; silences of links are minutes
        for k in range(12):
            when = k * minute if k < 6 else 50 * hour + k * minute
            captures.append((f"c{c}_{k:02d}", f"v{c}", k, f"c{c}_{k - 1:02d}" if k % 6 else None, 1, at(c * 1000 + when)))
    captures += [captures[0], ("late", None, 0, None, 1, at(5)), ("odd", "v0", 0, None, 1, "never")]
    schema = "capture_id string, conversation_id string, turn_index int, parent_capture_id string, recorder_id int, created_at string"
    c = spark.createDataFrame(captures, schema)
    recorders = spark.createDataFrame([(1, "UTC", None)], "recorder_id int, tz_name string, date_order string")
    m = spark.createDataFrame(talk(*[x[0] for x in captures[:240]], skip={("c3_07", 1)}), MESSAGE)
    assert 0 < by_time.calibrated_gap(by_time.timed_captures(c, recorders)) <= minute * 1_000_000
    got = by_time.sessions(c, m, recorders).collect()
    want = {(f"v{i}", k // 6, k % 6, f"c{i}_{k:02d}") for i in range(20) for k in range(12)}
    assert {tuple(r) for r in got} == {w for w in want if w[:2] != ("v3", 1)}  # a session with an unanswered capture goes whole
    assert rows(by_time.sessions(c.limit(0), m, recorders)) == []
    a = by_time.agreement(c, m, recorders).first()
    assert a.conversations >= a.in_one_session >= a.same_order >= a.same


def test_long_chains(spark):
    n = 300
    data = [(f"n{i}", f"n{i - 1}" if i else None, "root" if i == 0 else None) for i in range(n)] + [("lost", "gone", None)]
    got = {r.id: (r.value, r.steps) for r in nearest_ancestor(spark.createDataFrame(data, "id string, parent string, value string")).collect()}
    assert got == {f"n{i}": ("root", i) for i in range(1, n)}


# ---------------------------------------------------------------- tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = ["", None, " ", "a" * 5000, "<|endoftext|> ist's", "don't  stop\r\n\n\t x", "héllo — 你好 🙂🙃", "ab" * 3000] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32, 101])) for _ in range(rng.randrange(80))) for _ in range(300)]
    library = Tokenizer.from_file(tokenizer.VOCABULARY)
    library.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in tokenizer.with_token_count(df, "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_a_small_cache_changes_nothing(monkeypatch):
    with open(tokenizer.VOCABULARY, encoding="utf-8") as file:
        text = file.read()
    a, b = tokenizer.Encoder(text), tokenizer.Encoder(text)
    monkeypatch.setattr(tokenizer, "CACHE_WORDS", 3)
    for block in (["one two three", "two three four"], ["four five one"], ["one"]):
        small = b.encode(block)
        monkeypatch.setattr(tokenizer, "CACHE_WORDS", 1000)
        assert a.encode(block) == small
        monkeypatch.setattr(tokenizer, "CACHE_WORDS", 3)


# ---------------------------------------------------------------- mixing


def test_the_largest_mix_under_caps():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    total, flow = M.solve({a: 100, b: 1000}, {"a": 1, "b": 3, "none": 5}, {"a": 2, "b": 1, "none": 9})
    assert total in range(800, 804) and sum(x for p, _, s, x in flow if s == "a") == total // 4
    total, flow = M.solve({a: 10, b: 10, ab: 20}, {"a": 1, "b": 1}, {"a": 1, "b": 1})
    assert total == 40 + 0 or total == 41
    total, flow = M.solve({a: 100, b: 100}, {"a": 1, "b": 1}, {"a": 3, "b": 3})
    assert total in (600, 601) and {(u, x) for _, u, _, x in flow} == {(1, 100), (2, 100), (3, 100)}
    assert M.solve({a: 5}, {"a": 0}, {"a": 1}) == (0, []) and M.solve({}, {"a": 1}, {"a": 1}) == (0, [])


def test_many_patterns_and_cuts_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        sources = "abcd"[: rng.randrange(1, 5)]
        patterns = {frozenset(rng.sample(sources, rng.randrange(1, len(sources) + 1))): rng.randrange(0, 30) for _ in range(rng.randrange(1, 8))}
        weights, repeats = {s: float(rng.randrange(0, 4)) for s in sources}, {s: rng.randrange(0, 4) for s in sources}
        total, flow = M.solve(patterns, weights, repeats)
        held = {s for p, n in patterns.items() if n for s in p}
        wanted = {s: w for s, w in weights.items() if w and s in held and repeats[s]}
        quota = lambda t: {s: int(t * w / sum(wanted.values())) for s, w in wanted.items()}

        def feasible(t):  # Gale: no set of sources wants more than all that can serve it
            q = quota(t)
            sets = [{s for i, s in enumerate(sorted(wanted)) if k >> i & 1} for k in range(1, 1 << len(wanted))]
            return all(sum(q[s] for s in x) <= sum(n * max([repeats[s] for s in p if s in x], default=0) for p, n in patterns.items()) for x in sets)

        assert not wanted and (total, flow) == (0, []) or feasible(total) and not feasible(total + 1)
        reached, used = Counter(), Counter()
        for p, use, s, n in flow:
            reached[s] += n
            used[p, use] += n
            assert s in p and use <= repeats[s]
        assert all(reached[s] == q for s, q in quota(total).items()) if wanted else True
        assert all(n <= patterns[p] for (p, _), n in used.items())
    many = {frozenset(f"s{i}" for i in range(16) if k >> i & 1): 50 for k in range(1, 20_001)}
    names = {f"s{i}": 1.0 for i in range(15)}
    total, flow = M.solve(many, names, dict.fromkeys(names, 2))
    assert total >= 20_000 * 50 and max(u for _, u, _, _ in flow) == 2


@needs_vocabulary
def test_mix_reaches_its_shares(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(9999)) for _ in range(rng.randrange(3, 12))), "big" if i % 10 else "small") for i in range(600)]
    docs += [(1000, None, "big"), (1001, "", "small"), (1002, "no source", None)] + [(2000 + i, "the same text", s) for i, s in enumerate(("big", "small", "big"))]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("m", "big", 1.0, 3), ("m", "small", 1.0, 4), ("m", "gone", 2.0, 2), ("m", None, 1.0, 1), ("zero", "big", 0.0, 1), (None, "big", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    mixed = M.mix(documents, targets)
    got = {r.source: r for r in M.shares(mixed, targets).where("mix_name = 'm'").collect()}
    assert got["big"].actual_share == pytest.approx(0.5, abs=0.02) and got["small"].most_copies == 4 and got["gone"].tokens == 0 and got["gone"].wanted_share == 0.5
    taken = mixed.where("mix_name = 'm'").collect()
    assert len({(r.source, r.doc_id) for r in taken}) == len(taken) and not {r.doc_id for r in taken} & {1000, 1001, 1002}
    assert all(r.copies <= {"big": 3, "small": 4}[r.source] for r in taken)
    assert rows(mixed) == rows(M.mix(documents, targets)) and rows(M.mix(documents.limit(0), targets)) == []


# ---------------------------------------------------------------- reading level


def test_levels_separate_plain_from_learned_prose(spark):
    rng = random.Random(9)
    easy = ["the", "cat", "sat", "on", "a", "mat", "and", "we", "saw", "it"]
    hard = [f"{a}{b}{c}" for a in ("epistemo", "methodo", "hetero", "phenomeno", "idio") for b in ("logical", "scedastic", "syncratic", "graphic") for c in ("ally", "isation", "ity", "ness")]
    foreign = ["der", "wurde", "nicht", "weil", "prüfung", "ausgefallen", "größere"]
    make = lambda words, n, k: " ".join(" ".join(rng.choice(words) for _ in range(k)).capitalize() + "." for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        kind = i % 3
        text = make(easy, 12, 6) if kind == 0 else make(hard + easy[:4], 5, 30) if kind == 1 else make(foreign, 5, 30)
        docs.append((i, text, "en" if kind < 2 or i % 20 == 2 else "de"))
        if i % 4 == 0 and kind < 2:
            labels.append((i, 1 if kind == 0 else 5))
    docs += [(900, None, "en"), (901, "", "en"), (902, "1234 --- {}", None), (903, "x=1; y={'a': [1, 2]}\n" * 9, "en"), (904, make(hard, 300, 40), None)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("rank", F.lit(1))
    got = {r.doc_id: r for r in reading.reading_levels(documents, spark.createDataFrame([*labels, (0, None), (5000, 3)], "doc_id bigint, band int")).collect()}
    assert len(got) == len(docs)
    found = {d for d, r in got.items() if r.prose and r.level >= 4}
    assert found == {i for i in range(240) if i % 3 == 1} | {904}
    assert not any(got[d].prose for d in (900, 901, 902, 903)) and got[900].level is None
    none = reading.reading_levels(documents, spark.createDataFrame([], "doc_id bigint, band int"))
    assert none.where("level is not null").count() == 0
    assert reading.reading_levels(documents.limit(0), spark.createDataFrame(labels, "doc_id bigint, band int")).count() == 0


def test_exact_ranks_beyond_the_list(spark, monkeypatch):
    docs = [(i, " ".join(chr(97 + j) * 3 for j in range(i + 1)) + ".", "en" if i % 3 else "de") for i in range(20)]
    measured = reading.measures(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    full = rows(reading.coverage(measured, reading.vocabulary(measured)).select("doc_id", "rank"))
    whole = rows(reading.coverage(measured, reading.vocabulary(measured)))
    for listed in (3, 0):
        monkeypatch.setattr(reading, "LISTED", listed)
        assert rows(reading.coverage(measured, reading.vocabulary(measured)).select("doc_id", "rank")) == full
        assert rows(reading.coverage(measured, reading.vocabulary(measured))) == whole
    for doc, rank in full:
        assert rank == math.ceil((doc + 1) / 2)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/reading_labels.parquet").where("band is not null")
    train, held = labels.where("pmod(xxhash64(doc_id), 2) = 0"), labels.where("pmod(xxhash64(doc_id), 2) = 1")
    levels = reading.reading_levels(documents, train).join(held, "doc_id").select((F.col("level") >= 4).alias("a"), (F.col("band") >= 4).alias("b")).collect()
    assert sum(r.a == r.b for r in levels) / len(levels) >= 0.85


def test_messages_without_content_stay_in_their_dialogue(spark):
    from pairloom.llm.dialogues import whole_dialogues

    captures = spark.createDataFrame([("k", "v", 0, None)], "capture_id string, conversation_id string, turn_index int, parent_capture_id string")
    calls = [{"id": "c1", "type": "function", "function": {"name": "find", "arguments": "{}"}}]
    said = [(1, 0, "human", "find it", None, None), (2, 1, "Model", None, calls, None), (2, 1, "Model", None, calls, None), (3, 2, "tool", "", None, "c1"), (4, 3, "model", "here", None, None)]
    messages = spark.createDataFrame(
        [(m, "k", *rest) for m, *rest in said],
        "message_id bigint, capture_id string, seq int, role string, content string, tool_calls array<struct<id string, type string, function struct<name string, arguments string>>>, tool_call_id string",
    )
    got = whole_dialogues(captures, messages).orderBy("seq").collect()
    assert [(r.message_id, r.role, r.content) for r in got] == [(1, "user", "find it"), (2, "assistant", None), (3, "tool", ""), (4, "assistant", "here")]
    assert got[1].tool_calls[0].function.name == "find" and got[2].tool_call_id == "c1"
