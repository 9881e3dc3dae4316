"""Statistics against published values and brute force."""

from __future__ import annotations

import itertools
import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import slicing as L
from pairloom.operators import statistics as T


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (4.032143, 5, 0.01), (2.045230, 29, 0.05), (0.0, 7, 1.0)])
def test_t_tail(t, df, p):
    assert T.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(("n", "w"), [(6, 0), (8, 3), (10, 8), (15, 25), (20, 52)])
def test_signed_rank_critical_values(n, w):
    def p_at(stat):
        x, left = np.arange(1, n + 1, dtype=float), stat
        for i in range(n, 0, -1):  # the chosen ranks add up to the statistic
            if i <= left:
                left -= i
                x[i - 1] *= -1
        return T.wilcoxon(x)[1]

    assert p_at(w) <= 0.05 < p_at(w + 1)


def test_signed_rank_exact_equals_enumeration():
    x = np.array([1.5, -0.3, 2.2, 4.1, -3.3, 5.0])
    w, p = T.wilcoxon(x)
    sums = [sum(r for r, s in zip(range(1, 7), signs) if s) for signs in itertools.product([0, 1], repeat=6)]
    assert p == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 64))


def test_shapiro_published_example():
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    assert T.shapiro(weights) == pytest.approx(0.00670, abs=5e-4)
    rng = np.random.default_rng(1)
    assert sum(T.shapiro(rng.normal(size=60)) > 0.05 for _ in range(200)) > 175
    assert T.shapiro(rng.exponential(size=200)) < 1e-6


@pytest.mark.parametrize(("p", "q"), [([0.01, 0.04, 0.20], [0.03, 0.06, 0.20]), ([0.001, 0.001, 0.04], [0.0015, 0.0015, 0.04]), ([0.5], [0.5]), ([], [])])
def test_false_discovery(spark, p, q):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(99, None)], "k int, p double")
    got = {r.k: r.q for r in T.benjamini_hochberg(df, "p", ["k"]).collect()}
    assert got.pop(99) is None
    assert [got[i] for i in range(len(p))] == pytest.approx(q)


def test_wilson(spark):
    low, high = T.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(1, 10), (3, 3), (0, 0)], "h int, n int").select(low.alias("l"), high.alias("u")).collect()
    assert got[0].l == pytest.approx(0.0179, abs=1e-4) and got[1].l == pytest.approx(0.4385, abs=1e-4) and (got[2].l, got[2].u) == (0, 1)


def test_large_groups_get_the_same_rank_test(spark, monkeypatch):
    rng = np.random.default_rng(5)
    deltas = np.round(rng.exponential(size=400) - 0.9, 1)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "delta": deltas})).withColumn("error", F.lit(None).cast("string"))
    one = T.paired_tests(df, ["g"]).first()
    two = T.paired_tests(df, ["g"]).first()
    assert (one.test, two.test) == ("wilcoxon", "wilcoxon") and two.statistic == pytest.approx(one.statistic) and two.p == pytest.approx(one.p, rel=1e-9)


def test_gates(spark):
    data = [("few", 0.1)] * 4 + [("flat", 0.1)] * 9 + [("ok", x / 10) for x in range(7)]
    df = spark.createDataFrame(data, "g string, delta double").withColumn("error", F.lit(None).cast("string"))
    assert {r.g: r.gate for r in T.moments(df, ["g"]).collect()} == {"few": "insufficient", "flat": "skipped", "ok": "tested"}
    assert [r.g for r in T.paired_tests(df, ["g"]).collect()] == ["ok"]
    assert T.paired_tests(df.limit(0), ["g"]).count() == 0


def test_slices_repeat_tags_and_collapse(spark):
    scores = spark.createDataFrame([("p", e, "v", "k", 0.1, None) for e in "abc"] + [("p", "d", "v", "k", None, "bad")], "prompt_id string, example_id string, evaluator_name string, kind string, delta double, error string")
    examples = spark.createDataFrame([("a", ["x", "y", "captured"]), ("b", ["x", "y", "captured", "w", "w"]), ("c", None), ("d", ["z"])], "id string, tags array<string>")
    sliced = L.slice_rows(scores, examples)
    assert {(r.slice_name, r["count"]) for r in sliced.groupBy("slice_name").count().collect()} == {("all", 4), ("x", 2), ("y", 2), ("captured", 2), ("w", 2), ("z", 1)}
    kept = {r.slice_name: r.collapsed for r in L.dedupe_slices(sliced).collect()}
    assert kept == {"all": [], "x": ["y", "captured"], "w": []}
    assert rows(L.unmeasured_by_slice(scores, examples)) == sorted([("v", "k", "p", s, 1) for s in ("all", "z")], key=repr)


def test_groups_beyond_five_thousand_get_the_paired_t_test(spark):
    rng = np.random.default_rng(6)
    skewed = rng.exponential(size=5001) - 0.97
    df = spark.createDataFrame(pd.DataFrame({"g": ["more"] * 5001 + ["most"] * 5000, "delta": np.concatenate([skewed, skewed[:5000]])})).withColumn("error", F.lit(None).cast("string"))
    got = {r.g: r for r in T.paired_tests(df, ["g"]).collect()}
    assert (got["more"].test, got["most"].test) == ("paired_t", "wilcoxon")
    d = skewed.mean() / skewed.std(ddof=1)
    half = 1.96 * np.sqrt(1 / 5001 + d * d / 10002)
    assert got["more"].n == 5001 and got["more"].statistic == pytest.approx(d * np.sqrt(5001))
    assert got["more"].p == pytest.approx(T.t_two_sided(d * np.sqrt(5001), 5000), rel=1e-6)
    assert (got["more"].d_low, got["more"].d_high) == pytest.approx((d - half, d + half))
    assert T.t_two_sided(1.0, 10_000_000) == pytest.approx(0.3173105, abs=1e-6)


def test_reports_take_their_severity_from_the_paired_test(spark, tmp_path):
    from pairloom.plans.reference import REGISTRY

    # 30 deltas with t = -2.5: p is about 0.018, while 1 / (1 + t * t) is 0.14 and would say none.
    x = np.linspace(-2, 2, 30)
    x = (x - x.mean()) / x.std(ddof=1) - 2.5 / np.sqrt(30)
    scores = pd.DataFrame({"reg_id": range(30), "prompt_id": "p", "example_id": [f"e{i}" for i in range(30)], "evaluator_name": "v", "kind": "k", "delta": x, "source_score": 0.5, "target_score": 0.5, "explanation": "x"})
    spark.createDataFrame(scores).write.parquet(f"{tmp_path}/top_regressions.parquet")
    spark.createDataFrame([(1, "e0", ["w"])], "row_id bigint, id string, tags array<string>").write.parquet(f"{tmp_path}/golden.parquet")
    got = {n: {r.slice_name: r for r in REGISTRY.queries[n](spark, str(tmp_path)).collect()} for n in ("a9_tested_severity", "t1_tested_order")}
    assert got["a9_tested_severity"]["all"].severity == got["t1_tested_order"]["all"].severity == "medium"
    assert got["a9_tested_severity"]["w"].severity == "insufficient"
    worst = REGISTRY.queries["a34_tested_summary"](spark, str(tmp_path)).first()
    assert (worst.worst, worst.comparisons, worst.blocking) == (2, 1, 0)


def test_global_ranks_and_medians(spark):
    import random

    from pairloom.operators.ranking import global_rank
    from pairloom.operators.reports import medians

    rng = random.Random(4)
    data = [(i, rng.choice("abc"), rng.choice([None, 1.0, 2.5, float(rng.randrange(50))])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, g string, v double")
    ranked = {r.i: r.place for r in global_rank(df, [F.col("v").asc_nulls_last(), F.col("i").asc()], "place").collect()}
    assert ranked == {i: k + 1 for k, (i, _, _) in enumerate(sorted(data, key=lambda d: (d[2] is None, d[2] or 0, d[0])))}
    assert global_rank(df.limit(0), [F.col("v").asc()], "place").count() == 0
    want = {g: statistics.median([v for _, h, v in data if h == g and v is not None]) for g in "abc"}
    assert {r.g: r.median for r in medians(df, "v", ["g"]).collect()} == want


def test_groups_in_which_nothing_was_measured_get_a_row(spark):
    df = spark.createDataFrame([("a", 0.1, None), ("a", None, "x"), ("b", None, "x"), ("b", None, "y")], "k string, delta double, error string")
    got = {r.k: (r.n, r.notes) for r in T.with_silent(T.moments(df, ["k"]), df, ["k"]).collect()}
    assert got == {"a": (1, []), "b": (0, ["nothing measured: 2 failed"])}
